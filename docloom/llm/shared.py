"""Helpers that several corpus operators use: lineage cuts, row numbering, connected components."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters that the word pattern [^\x20\x09-\x0D]+ leaves out.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Keys with more than this part of the rows are joined by broadcast: there are fewer of them than this.
HUBS = 200


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that no later job repeats its work.

    The folder is the session's: spark.checkpoint.dir, which all executors must see.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir if that was not done yet.

    A session without one gets a temporary folder if it is local, that is all in one process; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-docloom-"))
    return sc.getCheckpointDir()


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3).cast("int")


def held_out(doc_id: Column) -> Column:
    """True for the rows that no model may learn from."""
    return fold(doc_id) == 1


def key_of(column: Column) -> Column:
    """A grouping key that is never null and tells null from every text."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("~"))


def numbered(df: DataFrame, key: str, order: list[Column], out: str, rows_per_part: int = 250, largest: int | None = None) -> DataFrame:
    """Add out: 0, 1, 2, ... within each value of key, following a hash of the order columns and then those columns.

    No key is numbered in a single task: rows are cut by hash into parts of about rows_per_part rows, or the square root of
    largest if that is more, so that neither a part nor the list of a key's parts is long.  Each part is numbered by itself
    and then moved by the size of the parts before it.  df is read twice; settle it first
    if it is costly.  key must not be null.
    """
    if largest is None:
        largest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-largest // max(rows_per_part, math.isqrt(largest))))
    cut = df.withColumn("__h", F.xxhash64(*order)).withColumn("__part", F.pmod("__h", F.lit(parts)))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(key, "__part").agg(F.count("*").alias("__n")).select(key, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(key, "__part").orderBy("__h", *order)
    return (
        cut.withColumn("__at", F.row_number().over(inside) - 1)
        .join(starts.hint("merge"), [key, "__part"])
        .withColumn(out, (F.col("__start") + F.col("__at")).cast("long"))
        .drop("__h", "__part", "__at", "__start")
    )


def by_key(rows: DataFrame, table: DataFrame, busy: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with the one row that table has of their key.

    busy holds the keys with so many rows that there are fewer than HUBS of them: those meet by broadcast, so their rows stay
    where they are, and the others by a shuffle.
    """
    names = F.broadcast(busy.select(key))
    few, rest = F.broadcast(table.join(names, key, "left_semi")), table.join(names, key, "left_anti")
    hot = rows.join(names, key, "left_semi").join(few, key, how)
    return hot.unionByName(rows.join(names, key, "left_anti").join(rest.hint("merge"), key, how))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (a, b) long pairs to (id, component), component the least id reachable.

    Alternates the large-star and small-star steps: every node hands its larger (then smaller) neighbours to the least
    node it knows, until nothing moves.  Each round is a shuffle of the remaining edges, cut by a checkpoint.
    Null ids and loops are ignored; ids without an edge do not appear in the result.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    e, last = settle(e), None
    for _ in range(most_rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("v", "u"))).first()
        if now == last or not now[0]:
            break
        last = now
        both = e.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(e.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"), F.count("*").alias("degree"))
        # a node with over 1/200 of all edge ends is a hub: there are fewer than 200, and their edges stay where they are
        hub = F.col("degree") * HUBS > 2 * now[0]
        hubs, rest = F.broadcast(least.where(hub).select("x", "m")), least.where(~hub).select("x", "m")
        larger = both.where("y > x")
        met = larger.join(hubs, "x").unionByName(larger.join(hubs, "x", "left_anti").join(rest.hint("merge"), "x"))
        large = met.select(F.col("y").alias("v"), F.col("m").alias("u")).where("v != u").distinct()
        smallest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(smallest.hint("merge"), "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("s")).select("s.*").where("v != u").distinct()
        e = settle(small)
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return e.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
