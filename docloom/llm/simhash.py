"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is looked at through blocks of bits, and each block through a perfect code: the binary Golay
code (23 bits, covering radius 3) and, where wished, the Hamming code (15 bits, radius 1).  The product of the codes is
the set of anchors.  A fingerprint's home is its nearest anchor, which is unique because the codes are perfect.  It is
also copied to every anchor within covering radius plus threshold.  If two fingerprints differ in at most that threshold,
the home of either is within radius plus threshold of the other, so the pair meets there: the search is exact.

Fingerprints are made distinct first, so copies of a text cost one row however many there are.

near_duplicates() links fingerprints.  one_of_each() thins a corpus by the similarity of word shingles instead: near copies in that
sense mostly differ in far more bits than anchors can cover, so texts that share a band of minima of their shingles' hashes
are candidates too, and what two texts have in common is then counted exactly.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import HUBS, by_key, components, key_of, settle

#: code name: (bits, generator polynomial, covering radius)
CODES = {"golay": (23, 0b101011100011, 3), "hamming": (15, 0b10011, 1)}
#: Two Golay blocks make 2**24 anchors; ("golay", "golay", "hamming") makes 2**35, for over about 10**9 fingerprints.
BLOCKS = ("golay", "golay")
CHUNK = 1 << 16


def mixed(h: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes of the same things: a fixed one-to-one mix of each hash (constants of the splitmix64 generator)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def signs(text: str | None, shingle: int, n: int) -> list[int]:
    """n unsigned 64-bit SimHashes of a whole text, each from other hashes of its shingles; zeros if it has no word."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: exactly A-Z, and exactly [\x20\x09-\x0D]
    if not words:
        return [0] * n
    line, digest, width = b" ".join(words), xxhash.xxh64_intdigest, min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    votes = np.zeros((n, 64), np.int64)
    for at in range(0, len(starts), CHUNK):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        for k in range(n):
            h = mixed(h) if k else h
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for i in range(0, len(bits), 255):  # sums of 255 bits fit a byte
                votes[k] += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return [sum(1 << int(i) for i in np.flatnonzero(2 * v > len(starts))) for v in votes]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text; zero if it has no word."""
    return signs(text, shingle, 1)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) with fp the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp long")


def remainders(words: np.ndarray, bits: int, poly: int) -> np.ndarray:
    """Of polynomials over GF(2): what tells a word from the code."""
    r, degree = words.astype(np.int64), poly.bit_length() - 1
    for k in range(bits - 1, degree - 1, -1):
        r = np.where((r >> k) & 1, r ^ (poly << (k - degree)), r)
    return r


@lru_cache
def offsets(code: str, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """By remainder: the error patterns that lead to each codeword within radius plus threshold, and their weight beyond the radius.

    Rows are padded with patterns whose excess is over any threshold; column 0 is the nearest codeword.
    """
    from itertools import combinations

    bits, poly, radius = CODES[code]
    patterns = np.array([sum(1 << i for i in c) for w in range(radius + threshold + 1) for c in combinations(range(bits), w)], np.int64)
    weight = np.array([int(x).bit_count() for x in patterns])
    rows: list[list[tuple[int, int]]] = [[] for _ in range(1 << (poly.bit_length() - 1))]
    for p, w, r in zip(patterns.tolist(), weight.tolist(), remainders(patterns, bits, poly).tolist(), strict=True):
        rows[r].append((p, max(0, w - radius)))
    most = max(map(len, rows))
    rows = [x + [(0, 99)] * (most - len(x)) for x in rows]
    return np.array([[p for p, _ in x] for x in rows], np.int64), np.array([[s for _, s in x] for x in rows], np.int64)


def anchors(fps: np.ndarray, blocks: tuple[str, ...], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into fps, anchor) of every anchor within reach; with threshold 0 just the homes."""
    fps = fps.view(np.uint64)
    index, anchor, spent, low = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64), 0
    for code in blocks:
        bits, poly, _ = CODES[code]
        part = ((fps[index] >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        pattern, excess = offsets(code, threshold)
        r = remainders(part, bits, poly)
        total = spent[:, None] + excess[r]
        row, col = np.nonzero(total <= threshold)
        anchor = anchor[row] | ((part[row] ^ pattern[r[row], col]) << low)
        index, spent, low = index[row], total[row, col], low + bits
    return index, anchor


def anchored(fps: DataFrame, blocks: tuple[str, ...], threshold: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(anchor, fp, more...) rows of distinct fingerprints; more are columns of longs that go along."""
    names = ["fp", *more]

    def run(batches):
        for batch in batches:
            kept = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            for at in range(0, batch.num_rows, 2048):
                index, anchor = anchors(kept[0][at : at + 2048], blocks, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), *(pa.array(c[at : at + 2048][index]) for c in kept)], ["anchor", *names])

    return fps.select(*names).mapInArrow(run, "anchor long, " + ", ".join(f"{c} long" for c in names))


def links(fps: DataFrame, threshold: int = 2, blocks: tuple[str, ...] = BLOCKS) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints that differ in 1 to threshold bits.  Each pair comes once.

    The join is by anchor.  A busy anchor is split by adaptive skew handling, and holds distinct fingerprints only.
    """
    homes = anchored(fps, blocks, 0).withColumnRenamed("fp", "a")
    around = anchored(fps, blocks, threshold).withColumnRenamed("fp", "b")
    return around.join(homes.hint("shuffle_hash"), "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, blocks: tuple[str, ...] = BLOCKS) -> DataFrame:
    """One row per document: its id, fingerprint (16 hex digits) and component_id, the least id linked to it over any path.

    Null and empty texts have fingerprint zero and are linked like any other.  Repeated rows stay.  Null ids never name a
    component unless it has no other.  Other columns of docs are neither read nor returned.
    """
    docs_fp = settle(fingerprints(docs, id_col, text_col))
    distinct = settle(docs_fp.groupBy("fp").agg(F.min("id").alias("least")))
    comp = components(links(distinct, threshold, blocks))
    named = distinct.join(comp.withColumnRenamed("id", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "component").join(least.hint("merge"), "component").select("fp", "component_id")
    return docs_fp.join(named.hint("merge"), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Jaccard similarity of near copies.
SIMILAR = 0.8
#: Bands of minima that near copies are looked for by, and minima in each: two texts alike by 0.8 share no band once in 5,000 times.
BANDS, MINIMA = 16, 4
#: Texts of a bucket that each of its other texts is compared with in one task.
PART = 128


@lru_cache
def multipliers(n: int) -> np.ndarray:
    """n odd 64-bit numbers; times a hash, their upper halves are other hashes."""
    return np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: str | None, width: int, bands: int = BANDS, minima: int = MINIMA) -> tuple[int, list[int], np.ndarray]:
    """SimHash of a whole text, a signed key for each band, and the sorted distinct 32-bit hashes of its word shingles.

    A shorter text is one shingle.  A text without words has fingerprint zero, no hash, and keys that all such texts share.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    width = min(width, len(words))
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1 if words else np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1)) if words else ends
    n = len(words) - width + 1 if words else 0
    h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist() if n else (), strict=True)), np.uint64, n)
    votes, least, by = np.zeros(64, np.int64), np.full(bands * minima, 1 << 32, np.uint64), multipliers(bands * minima)
    for at in range(0, n, 4096):
        part = h[at : at + 4096]
        votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, ((part[:, None] * by) >> np.uint64(32)).min(axis=0))
    keys = [digest(least[k * minima : (k + 1) * minima].tobytes(), k) for k in range(bands)]
    fp = sum(1 << int(i) for i in np.flatnonzero(2 * votes > n))
    return fp, np.array([fp, *keys], np.uint64).view(np.int64).tolist(), np.unique(h.astype(np.uint32)).view(np.int32)


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """texts(id, th, text) to (id, th, fp, keys, s)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                made = [sketch(t, width) for t in part.column(2).to_pylist()]
                columns = [pa.array([m[1][0] for m in made], pa.int64()), pa.array([m[1][1:] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["id", "th", "fp", "keys", "s"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, th long, fp long, keys array<long>, s array<int>")


def leaders(rows: DataFrame, turns: range, similarity: float) -> DataFrame:
    """(ta, tb, place, ok): texts beside the first text of each bucket that they share, one first for each turn.

    rows has key, th, n and label.  The first of a bucket is so by a hash that changes with the turn, so a bucket of any size makes
    at most one pair a text and turn.  Buckets of one label are left out.  ok: the labels differ and the sizes are near enough.
    """
    first = [F.min(F.struct(F.xxhash64("th", F.lit(t)).alias("o"), F.col("th"), F.col("n"), F.col("label"))) for t in turns]
    lead = settle(rows.groupBy("key").agg(F.array(*first).alias("firsts"), F.count("*").alias("many"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi"))
    total = lead.agg(F.sum("many")).first()[0] or 0
    # a key with over 1/200 of all rows is busy: there are fewer than 200, and their rows stay where they are
    busy = [r["key"] for r in lead.where(F.col("many") * HUBS > total).select("key").collect()]
    few, rest = F.broadcast(lead.where(F.col("key").isin(busy)).select("key", "firsts")), lead.where(~F.col("key").isin(busy)).select("key", "firsts")
    met = rows.where(~F.col("key").isin(busy)).join(rest.hint("merge"), "key")
    if busy:
        met = met.unionByName(rows.where(F.col("key").isin(busy)).join(few, "key"))

    def differ(f):
        return (f["label"] != F.col("label")) & (F.greatest(F.col("n"), f["n"]) * similarity <= F.least(F.col("n"), f["n"]))

    if len(turns) > 1:
        return met.select("th", F.explode(F.filter("firsts", differ)).alias("f")).select(F.col("f.th").alias("ta"), F.col("th").alias("tb"), F.col("f.o").alias("place"), F.lit(True).alias("ok"))
    f = F.col("firsts")[0]
    return met.select(f["th"].alias("ta"), F.col("th").alias("tb"), f["o"].alias("place"), differ(f).alias("ok"))


def similar(a: Column, b: Column, similarity: float) -> Column:
    """Are two sets that similar?  Two empty ones are."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), True).otherwise(shared >= similarity * (F.size(a) + F.size(b) - shared))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (ta, tb) those whose sets(th, s) are that similar; two empty sets are."""
    # a text that leads many others meets them where they are
    busy = settle(pairs.groupBy("ta").count().where(F.col("count") * HUBS > pairs.count()))
    both = pairs.join(sets.select(F.col("th").alias("tb"), F.col("s").alias("sb")).hint("merge"), "tb")
    both = by_key(both, sets.select(F.col("th").alias("ta"), F.col("s").alias("sa")), busy, "ta")
    return both.where(similar(F.col("sa"), F.col("sb"), similarity)).select("ta", "tb")


def across(rows: DataFrame, sets: DataFrame, similarity: float, turns: range) -> DataFrame:
    """(ta, tb): all pairs of texts that share a bucket of rows(key, th, n, label), differ in label and are alike, each once.

    Pairs with a bucket's firsts are left out, as leaders gave them for these turns.  Rows of a bucket's commonest label meet only those of
    others, so a bucket of one label costs nothing.  Sets go to the buckets, once for each PART texts of a bucket, and are compared there:
    what is shuffled does not grow with the pairs, and a large bucket fills several tasks.
    """
    first = [F.min(F.struct(F.xxhash64("th", F.lit(t)).alias("o"), "th"))["th"] for t in turns]
    lead = rows.groupBy("key").agg(F.array(*first).alias("firsts"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    left = settle(rows.join(lead.select("key", "firsts").hint("merge"), "key").where(~F.array_contains("firsts", F.col("th"))).drop("firsts"))
    sizes = left.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("m"), F.count("*").alias("labels"), F.ceil(F.sum("count") / PART).cast("int").alias("parts"))
    mixed_up = settle(left.join(sizes.where("labels > 1").select("key", F.col("m.label").alias("most"), "parts").hint("merge"), "key"))
    whole = mixed_up.join(sets.select("th", "s").hint("merge"), "th")
    # few bytes can mean many pairs, so adaptive plans must not put parts together by their bytes
    dealt = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "part")
    x = dealt(whole.where("label <> most").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))).alias("x")
    y = dealt(whole.withColumn("part", F.pmod(F.xxhash64("th", F.lit(0)), F.col("parts")).cast("int"))).alias("y")
    once = (F.col("y.label") == F.col("y.most")) | (F.col("x.th") < F.col("y.th"))
    near = F.greatest("x.n", "y.n") * similarity <= F.least("x.n", "y.n")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.label") != F.col("y.label")) & once & near
    met = x.join(y.hint("merge"), same & similar(F.col("x.s"), F.col("y.s"), similarity))
    return met.select(F.least("x.th", "y.th").alias("ta"), F.greatest("x.th", "y.th").alias("tb")).distinct()


def near_copies(marked: DataFrame, one: DataFrame, similarity: float = SIMILAR, blocks: tuple[str, ...] = BLOCKS, turns: int = 4) -> DataFrame:
    """(th, component): texts that are linked by the similarity of their shingles, over any path; texts without a link do not appear.

    marked has th and s, one has a row for each th with fp, keys and n.  Candidates are fingerprints within 2 bits, which the anchors
    give without loss, and texts that share a band of minima or a fingerprint: pairs at 0.8 mostly differ in more bits.  First each text
    is compared with one candidate, and a link that holds labels it by that candidate.  Then whatever shares a bucket but no label is
    compared with other firsts of its buckets, one in each of the further turns, and components are formed.  Buckets that then still hold
    several components are compared whole across them, so turns only save work.  Every link is checked on the whole sets.  A link is lost
    only if its texts share no bucket.
    """
    key = F.explode(F.concat("keys", F.array("fp"))).alias("key")
    firsts = one.groupBy("fp").agg(F.min("th").alias("first"))
    homes = anchored(firsts, blocks, 0, ("first",)).select("anchor", F.col("fp").alias("a"), F.col("first").alias("ta"))
    around = anchored(firsts, blocks, 2, ("first",)).select("anchor", F.col("fp").alias("b"), F.col("first").alias("tb"))
    near = around.join(homes.hint("shuffle_hash"), "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
    near = near.select("ta", "tb", F.lit(None).cast("long").alias("place"), F.lit(True).alias("ok"))
    met = leaders(one.select("th", "n", F.col("th").alias("label"), key), range(1), similarity)
    # one candidate a text: what is near in bits before others, and else the least of its buckets' firsts, which many texts share
    found = met.unionByName(near).select(F.col("tb").alias("th"), F.when(F.col("ok"), F.struct(F.col("place").isNotNull().alias("far"), "place", "ta")).alias("m"))
    found = found.unionByName(near.select(F.col("ta").alias("th"), F.lit(None).cast(found.schema["m"].dataType).alias("m")))
    chosen = settle(found.groupBy("th").agg(F.min("m").alias("m")))
    sets = settle(marked.select("th", "s").join(chosen.select("th").hint("merge"), "th", "left_semi").dropDuplicates(["th"]))
    edges = settle(alike(chosen.where("m is not null").select("m.ta", F.col("th").alias("tb")), sets, similarity))

    # labels are one or two links away: finer than components, so no pair is left out that components would compare
    far = edges.alias("x").join(edges.select(F.col("tb").alias("ta"), F.col("ta").alias("up")).hint("merge"), "ta", "left").select(F.col("tb").alias("th"), F.coalesce("up", "ta").alias("label"))
    able = one.select("th", "n", "fp", "keys").join(chosen.select("th").hint("merge"), "th", "left_semi")
    able = settle(able.join(far.hint("merge"), "th", "left").withColumn("label", F.coalesce("label", "th")))
    pairs = settle(leaders(able.select("th", "n", "label", key), range(1, turns), similarity).select("ta", "tb").distinct())
    both = edges.unionByName(alike(pairs, sets, similarity))
    comp = settle(components(both.select(F.col("ta").alias("a"), F.col("tb").alias("b"))).select(F.col("id").alias("th"), "component"))

    # what no first has shown: a bucket that still holds several components is compared across them, whatever its size
    now = settle(able.select("th", "n", "fp", "keys").join(comp.hint("merge"), "th", "left").withColumn("label", F.coalesce("component", "th")).drop("component"))
    late = settle(across(now.select("th", "n", "label", key), sets, similarity, range(1, turns)))
    if late.isEmpty():
        return comp
    label = lambda c: now.select(F.col("th").alias(c), F.col("label").alias(f"l{c}")).hint("merge")
    ends = late.join(label("ta"), "ta").join(label("tb"), "tb")
    joined = components(ends.select(F.col("lta").alias("a"), F.col("ltb").alias("b"))).select(F.col("id").alias("label"), F.col("component").alias("all"))
    found = comp.select("th", F.col("component").alias("label")).unionByName(ends.select(F.explode(F.array(F.struct(F.col("ta").alias("th"), F.col("lta").alias("label")), F.struct(F.col("tb").alias("th"), F.col("ltb").alias("label")))).alias("e")).select("e.*")).distinct()
    return found.join(joined.hint("merge"), "label", "left").select("th", F.coalesce("all", "label").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = SIMILAR, blocks: tuple[str, ...] = BLOCKS) -> DataFrame:
    """docs with one row of each group of near copies: texts that share words-word shingles at the Jaccard similarity, over any path.

    The row that stays has the least id of its group, null ids last, then the least text hash.  Copies of a text and repeated
    rows are one group.  Texts without a word are one group, null among them.  Texts are read whole, however long.  All columns
    and clashing names stay, but for __th and __id, which are dropped.
    """
    own = docs.withColumn("__th", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).withColumn("__id", key_of(F.col(id_col)))
    marked = settle(sketches(own.select(F.col(id_col).alias("id"), F.col("__th").alias("th"), F.col(text_col).cast("string")), words))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("least")
    one = settle(marked.groupBy("th").agg(least, F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first(F.size("s")).alias("n")))
    comp = near_copies(marked, one, similarity, blocks)
    named = one.select("th", "least").join(comp.hint("merge"), "th", "left").withColumn("component", F.coalesce("component", "th"))
    stay = named.groupBy("component").agg(F.min(F.struct("least", "th")).alias("m")).select(F.col("m.th").alias("__th"), key_of(F.col("m.least.id")).alias("__id"))
    kept = own.join(stay.hint("merge"), ["__th", "__id"], "left_semi")
    return kept.dropDuplicates(["__th", "__id"]).drop("__th", "__id")


def op3_simhash_near_dedup(spark, sf_dir):
    from docloom.llm.shared import read

    return near_duplicates(read(spark, sf_dir, "documents"))
