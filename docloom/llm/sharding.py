"""Sharding by vector bin packing over bytes, tokens and rows.

The unit is the group: all documents with equal text go to one shard.  Small groups are first gathered by hash into a
fixed number of lots; a group whose share of any measure is larger than a lot's is placed by itself.  Only a group with more
bytes than a whole shard is cut, by document id, into as few pieces as fit.  So what is placed one after the other is bounded
by a parameter and not by the data: lots, and at most three times as many single groups.  Each item, largest first, goes to the shard
where the dot product of its vector with the residual capacity is highest among those it fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import WORD, numbered, settle

LOTS = 4096


def pack(items: list[tuple], shards: int) -> dict:
    """items: (key, bytes, tokens, rows).  Returns key to shard; ties go to the lower shard."""
    totals = [max(1, sum(x[k] for x in items)) for k in (1, 2, 3)]
    room = [[1.0 / shards] * 3 for _ in range(shards)]
    placed = {}
    for key, *size in sorted(items, key=lambda x: (-max(a / t for a, t in zip(x[1:], totals, strict=True)), str(x[0]))):
        v = [a / t for a, t in zip(size, totals, strict=True)]
        fits = [s for s in range(shards) if all(r >= a - 1e-12 for r, a in zip(room[s], v, strict=True))]
        dot = lambda s: sum(r * a for r, a in zip(room[s], v, strict=True))
        # what fits nowhere goes where bytes have most room: sizes in bytes are the law
        best = max(fits, key=lambda s: (dot(s), -s)) if fits else max(range(shards), key=lambda s: (room[s][0], -s))
        placed[key] = best
        room[best] = [r - a for r, a in zip(room[best], v, strict=True)]
    return placed


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )


def shard(docs: DataFrame, shards: int = 16, lots: int = LOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in its shard), grown_shard (null).

    size is the text's UTF-8 bytes plus 1; a null text counts as empty.  Equal texts share a shard unless their group
    has more bytes than a shard's fair share, when it is cut by id into as few pieces as fit; rows of one id stay together.
    Repeated rows keep a slot each.  Very long texts are one row like any other.  Other columns are neither read nor
    returned.  An empty table gives an empty result.
    """
    rows = settle(measured(docs, id_col, text_col))
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    total = groups.agg(F.sum("b"), F.sum("t"), F.sum("n")).first()
    total = [max(1, x or 0) for x in total]
    share = F.greatest(*(F.col(c) / F.lit(float(x)) for c, x in zip("btn", total, strict=True)))
    large = groups.where(share > 1.0 / lots).select("text_hash", "b").collect()  # at most 3 * lots groups
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame([(h, -(-b * shards // total[0])) for h, b in large], "text_hash long, pieces int")
    lot = F.pmod(F.xxhash64(F.col("text_hash"), F.lit(7)), F.lit(lots))
    keyed = rows.join(F.broadcast(table), "text_hash", "left").withColumn(
        "item", F.when(F.col("pieces").isNull(), F.format_string("lot %d", lot)).otherwise(F.format_string("group %d.%d", "text_hash", F.pmod(F.xxhash64("id", F.lit(11)), F.greatest(F.col("pieces"), F.lit(1)))))
    )
    items = [tuple(r) for r in keyed.groupBy("item").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect()]
    placed = spark.createDataFrame(list(pack(items, shards).items()), "item string, shard int")
    placed_rows = keyed.join(F.broadcast(placed), "item").select("id", "size", "text_crc32", "text_hash", F.col("shard").cast("string").alias("key"), "shard")
    most = placed_rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    return numbered(placed_rows, "key", [F.col("id"), F.col("text_hash")], "slot", largest=most).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_vector_bin_packing(spark, sf_dir):
    from docloom.llm.shared import read

    return shard(read(spark, sf_dir, "documents"))
