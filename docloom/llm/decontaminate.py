"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of consecutive item words.  For every length of window there is a shift table: it tells by the
last two words before a position how far the window can be moved before any test string could end there.  Where it cannot be
moved, the block's bucket gives the test strings that end in it and whose hash is that of the words in view, and these
are compared word by word.

The test strings are the small side, but they may grow: they are sent to the tasks in passes of a bounded size, and what the
passes find is put together by document.  Documents stay where they are.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.license_scan import words_of
from docloom.llm.shared import settle

WINDOW = 10
#: Bytes of item text that are sent to the tasks at once, and words of an item that stay together.
MOST_BYTES = 4 << 20
PIECE = 10_000


class Strings:
    """Test strings of one length: shift table and suffix buckets."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[int, list[tuple[list, int, set]]]] = defaultdict(dict)

    def add(self, words: list[bytes], item: str) -> None:
        """All windows of words.  Windows with the same words are one test string with several items."""
        n, b = self.length, self.block
        for at in range(len(words) - n + 1):
            bucket = self.buckets[tuple(words[at + n - b : at + n])].setdefault(hash(tuple(words[at : at + n])), [])
            for other, start, items in bucket:
                if other[start : start + n] == words[at : at + n]:
                    items.add(item)
                    break
            else:
                bucket.append((words, at, {item}))
        # the last window that a block can stand in leaves the least shift; a block at word `end` has n - 1 windows behind it
        for end in range(b - 1, len(words)):
            block = tuple(words[end - b + 1 : end + 1])
            least = max(0, n - 1 - end)  # 0 as soon as some window ends here
            self.shift[block] = min(least, self.shift.get(block, self.far))

    def find(self, words: list[bytes], spans: list[tuple[int, int]], found: list[set]) -> None:
        """Append the (start, end) of every occurrence, and the items of its test string."""
        n, b, far, shift, buckets = self.length, self.block, self.far, self.shift, self.buckets
        at, end = n - 1, len(words)
        while at < end:
            block = tuple(words[at - b + 1 : at + 1])
            if step := shift.get(block, far):
                at += step
                continue
            view = words[at - n + 1 : at + 1]
            for other, start, items in buckets[block].get(hash(tuple(view)), ()):
                if other[start : start + n] == view:
                    spans.append((at - n + 1, at + 1))
                    found.append(items)
            at += 1


def tables(pieces: list[tuple[str, bytes]], window: int) -> list[Strings]:
    by_length: dict[int, Strings] = {}
    for item, line in pieces:
        if words := line.split():
            n = min(window, len(words))
            by_length.setdefault(n, Strings(n)).add(words, item)
    return list(by_length.values())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that neither touch nor overlap, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def pieces_of(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, line, size): the words of each item joined by spaces, long items cut so that each window lies in one piece."""

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text or "")
                out += [(item, b" ".join(words[at : at + PIECE + window - 1])) for at in range(0, max(1, len(words) - window + 1), PIECE) if words]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary()), pa.array([len(x[1]) for x in out], pa.int64())], ["item", "line", "size"])

    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string")).mapInArrow(run, "item string, line binary, size long").distinct()


def passes_of(pieces: DataFrame, most: int) -> tuple[Column, int]:
    """Which pass a piece goes with, and how many there are: none over twice most bytes, unless a single piece is."""
    total, largest = pieces.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    n = max(1, -(-total // most))
    while True:
        part = F.pmod(F.xxhash64("item", "line"), F.lit(n))
        if n == 1 or pieces.groupBy(part.alias("p")).agg(F.sum("size").alias("s")).agg(F.max("s")).first()[0] <= max(2 * most, largest + most):
            return part, n
        n *= 2


def search(docs: DataFrame, pieces: list[tuple[str, bytes]], id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, text hash, n_words, spans, items) by document, from one pass of test strings."""
    strings = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        known = tables(strings.value, window)
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                words, spans, found = words_of(text or ""), [], []
                for table in known:
                    table.find(words, spans, found)
                rows.append((len(words), [{"start": a, "end": b} for a, b in merged(spans)], sorted(set().union(*found))))
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", "th", "n_words", "spans", "items"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text).mapInArrow(run, f"id {kind}, th long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per document, repeated rows included: id, n_words, spans (hit words as [start, end)), items (sorted ids as text).

    A window is that many consecutive words of an item, or all its words if it has fewer.  Null and empty texts have no words,
    neither in documents nor in items.  A null item id counts as the empty text; items that share an id are one item.
    Long texts are read whole.  Other columns are neither read nor returned.  Without items or documents nothing is hit.
    """
    pieces = settle(pieces_of(items, item_col, item_text, window))
    part, n = passes_of(pieces, most_bytes)
    results = []
    for k in range(n):
        chosen = [(r["item"], bytes(r["line"])) for r in pieces.where(part == k).select("item", "line").collect()]
        results.append(search(docs, chosen, id_col, text_col, window))
    if n == 1:
        return results[0].select(F.col("id").alias(id_col), "n_words", "spans", "items")
    # each pass keeps its hits only, once for repeated rows
    hits = None
    for k, r in enumerate(results):
        r = r.where(F.size("items") > 0).select("id", "th", F.lit(k).alias("k"), "spans", "items")
        hits = r if hits is None else hits.unionByName(r)
    one = hits.groupBy("id", "th", "k").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
    all_hits = one.groupBy("id", "th").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    last = F.col("acc")[F.size("acc") - 1]
    join_spans = F.expr("""aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (acc, s) ->
        if(size(acc) > 0 and s.start <= acc[size(acc) - 1].end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[size(acc) - 1].start, 'end', greatest(s.end, acc[size(acc) - 1].end)))),
           concat(acc, array(s))))""")
    all_hits = settle(all_hits.select(F.col("id").alias("__id"), F.col("th").alias("__th"), join_spans.alias("spans"), "items"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = results[0].select("id", "th", "n_words")
    joined = base.join(all_hits.hint("merge"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    return joined.select(F.col("id").alias(id_col), "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def op11_wu_manber_decontamination(spark, sf_dir):
    from docloom.llm.shared import read

    found = occurrences(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Documents and items that share an id are one in this SQL; the tables have none.
ORACLE = f"""
with d as (select doc_id, {WORDS} as w from documents), b as (select item_id::varchar as item, {WORDS} as w from benchmark),
lengths as (select item, w, least(len(w), {WINDOW}) as n from b where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as win from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from lengths)),
kinds as (select distinct n from windows),
grams as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, kinds where len(w) >= n)),
hits as (select distinct doc_id, n, i, item from grams join windows using (n, win)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join named using (doc_id)
"""
