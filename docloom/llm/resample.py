"""Importance resampling towards a target distribution, over hashed word features.

A feature's bucket is a CRC of its bytes.  The distinct features of some texts are grouped by length; each group is a matrix of
bytes, a row a feature, and all its CRCs are updated one column at a time.  The buckets are then scattered back to the texts.

Counts by bucket over all documents and all target texts give each bucket a gain; a document's weight is the mean gain of its
features.  Its score adds Gumbel noise drawn from its id, so that the highest scores are a draw without replacement in
proportion to the weights.  The features are formed twice, since texts are smaller than their lists of buckets.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.license_scan import words_of
from docloom.llm.shared import settle

BUCKETS = 10_000
LEAST_WORDS = 20
#: Bytes of a feature from which on it is hashed alone: a matrix of one row has nothing to update together.
ALONE = 1000
#: Words of texts that are hashed together at most, unless a single text has more.
TOGETHER = 200_000


@lru_cache
def crc_table() -> np.ndarray:
    """CRC-32 of each byte by the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def crcs(features: list[bytes]) -> np.ndarray:
    """Unsigned CRC-32 of each feature, by matrices of features of the same length."""
    table, out = crc_table(), np.zeros(len(features), np.uint32)
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if features else ():
        length = int(lengths[rows[0]])
        if length >= ALONE:
            out[rows] = [zlib.crc32(features[i]) for i in rows.tolist()]
            continue
        matrix = np.frombuffer(b"".join([features[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), length)
        columns = np.ascontiguousarray(matrix.T)
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for k in range(length):
            crc = table[(crc ^ columns[k]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def bucket_lists(texts: list[list[bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all features, their number by text): single words and pairs of neighbours, of texts given as words."""
    n = np.array([len(w) for w in texts], np.int64)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in texts for w in words), np.int64, int(n.sum()))
    words = list(numbers)
    single = crcs(words) % buckets
    last = np.zeros(len(ids), bool)
    ends = np.cumsum(n)[n > 0] - 1
    last[ends] = True
    first = np.flatnonzero(~last)
    pairs, back = np.unique(ids[first] * len(words) + ids[first + 1], return_inverse=True) if len(first) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    double = crcs([words[p // len(words)] + b" " + words[p % len(words)] for p in pairs.tolist()]) % buckets
    # each word's bucket, then that of the pair it begins, if it does
    spread = np.full((len(ids), 2), -1, np.int64)
    spread[:, 0] = single[ids] if len(ids) else 0
    spread[first, 1] = double[back]
    flat = spread.ravel()
    return flat[flat >= 0], np.maximum(2 * n - 1, 0)


def together(texts: list[str | None]):
    """(first, words of the texts from there on), few enough words at a time."""
    at, held, size = 0, [], 0
    for k, text in enumerate(texts):
        words = words_of(text or "")
        if held and size + len(words) > TOGETHER:
            yield at, held
            at, held, size = k, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield at, held


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of all texts; tasks add up before they hand on.  Null texts have none."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in together(batch.column(0).to_pylist()):
                total += np.bincount(bucket_lists(texts, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """By bucket: floor of 1000 times the log of its smoothed share in target over that in source.  There are as many as buckets."""
    s, t = [0] * buckets, [0] * buckets
    for counts, docs in ((s, source), (t, target)):
        for r in bucket_counts(docs, text_col, buckets).collect():
            counts[r["bucket"]] = r["n"]
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((float(b + 1) * (all_s + buckets)) / (float(a + 1) * (all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def noise(seed: int, doc_id: str) -> int:
    """Gumbel noise in thousandths from a digest of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score) by document.  Null texts have no features and weight 0; a null id counts as empty text."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        table = sent.value
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for _, texts in together(batch.column(2).to_pylist()):
                flat, n = bucket_lists(texts, len(table))
                running = np.concatenate(([0], np.cumsum(table[flat])))
                ends = np.cumsum(n)
                sums = running[ends] - running[ends - n]
                weights += np.where(n > 0, sums // np.maximum(n, 1), 0).tolist()
                n_words += [len(w) for w in texts]
                n_features += n.tolist()
            score = [w + noise(seed, i) for w, i in zip(weights, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights, score))], ["id", "n_words", "n_features", "weight", "score"])

    text_id = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col), text_id.alias("__text_id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """rows with out: 1, 2, 3, ... in the whole order, null ids and all, without bringing them to one task.

    Rows are sorted into ranges and numbered inside each; ranges are as many as shuffle partitions, and so are the offsets.
    A hash of the row's place spreads rows that are equal in the order.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    inside = salted.repartitionByRange(parts, *order, "__salt").sortWithinPartitions(*order, "__salt").withColumn("__at", F.monotonically_increasing_id()).drop("__salt")
    inside = settle(inside)
    part = F.shiftright("__at", 33)
    sizes = sorted((r["p"], r["n"]) for r in inside.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = spark.createDataFrame([(p, start) for (p, _), start in zip(sizes, starts)], "__p long, __start long")
    return inside.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn(out, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__p", "__start", "__at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = LEAST_WORDS, seed: int = 7, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, repeated rows included: id, n_features, weight, score and rank, null unless drawn.

    percent of the documents with at least least_words words are drawn, rounded down: the highest scores, ties to smaller ids,
    null ids last.  Null and empty texts have no features, weight 0 and are never drawn.  Rows that share an id share its noise; equal
    rows get ranks next to each other.  Texts are read whole, however long.  Other columns are neither read nor returned.
    Without target texts all features are as rare there; without documents there are no rows.
    """
    rows = settle(scored(docs, gains(docs, target, text_col, buckets), seed, id_col, text_col))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    inside = ranked(able, [F.col("score").desc(), F.col("id").asc_nulls_last()])
    inside = inside.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = inside.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark, sf_dir):
    from docloom.llm.shared import read

    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
