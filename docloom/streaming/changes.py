"""Following file changes: latest state by file in micro-batches, without the changes that applied moves cause.

Events: event_id, ts, path, kind (create, modify, move, delete), new_path for moves, mtime_us.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.versions import VersionedTable


def steps(events: DataFrame) -> DataFrame:
    """A move is a delete of the old path and a create of the new one: (event_id, ts, path, gone, mtime_us)."""
    gone = F.struct("path", F.lit(True).alias("gone"))
    there = F.struct(F.coalesce(F.when(F.col("kind") == "move", F.col("new_path")), F.col("path")).alias("path"), F.lit(False).alias("gone"))
    parts = F.when(F.col("kind") == "move", F.array(gone, there)).when(F.col("kind") == "delete", F.array(gone)).otherwise(F.array(there))
    return events.select("event_id", "ts", F.explode(parts).alias("s"), "mtime_us").select("event_id", "ts", "s.path", "s.gone", "mtime_us")


def latest_state(events: DataFrame) -> DataFrame:
    """(path, gone, mtime_us, ts, event_id): what the last event says of each path; a map-side maximum, no sort."""
    newest = F.max(F.struct("ts", "event_id", "gone", "mtime_us")).alias("l")
    return steps(events).groupBy("path").agg(newest).select("path", "l.gone", "l.mtime_us", "l.ts", "l.event_id")


def apply_changes(table: DataFrame, events: DataFrame) -> DataFrame:
    """table(path, mtime_us, ts, event_id) after the events; older events than the table's row change nothing."""
    now = latest_state(events).unionByName(table.select("path", F.lit(False).alias("gone"), "mtime_us", "ts", "event_id"))
    newest = F.max(F.struct("ts", "event_id", "gone", "mtime_us")).alias("l")
    return now.groupBy("path").agg(newest).where(~F.col("l.gone")).select("path", "l.mtime_us", "l.ts", "l.event_id")


def without_own(events: DataFrame, moves: DataFrame, seconds: int = 10) -> DataFrame:
    """Events that no applied move of about that time explains; moves(path, applied_at)."""
    m = moves.select(F.col("path").alias("__p"), "applied_at")
    band = (F.col("path") == F.col("__p")) & F.col("ts").between(F.col("applied_at") - F.expr(f"interval {seconds} seconds"), F.col("applied_at") + F.expr(f"interval {seconds} seconds"))
    return events.join(m, band, "left_anti")


def follow(spark: SparkSession, source: str, schema: str, table: str, checkpoint: str, on_change: Callable[[DataFrame], None] | None = None, own_moves: DataFrame | None = None, files_per_batch: int | None = None) -> int:
    """Run what there is of a folder of event files into versions of a table, once.  Returns the last version.

    The table is one in versions: a batch writes the buckets of the paths that it touches, and a batch that runs twice writes the
    same rows again.  Events may come late, out of order and more than once: the state keeps the newest of each path by time and
    event id, gone ones too, so any order gives the same table.  own_moves(path, applied_at): changes that they explain are left
    out.  Where nothing is new, the last version is returned, or -1 if there is none.
    """
    stream = spark.readStream.schema(schema).options(**({"maxFilesPerTrigger": files_per_batch} if files_per_batch else {})).parquet(source)
    state = state_table(spark, table)

    def batch(rows: DataFrame, number: int) -> None:
        changed = (rows if own_moves is None else without_own(rows, own_moves)).persist()
        try:
            state.commit(latest_state(changed), newest_of, number)
            if on_change is not None:
                on_change(latest_state(changed))
        finally:
            changed.unpersist()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return state.last()


STATE = "path string, gone boolean, mtime_us long, ts timestamp, event_id long"


def state_table(spark: SparkSession, table: str) -> VersionedTable:
    return VersionedTable(spark, table, STATE, "path")


def newest_of(table: DataFrame, states: DataFrame) -> DataFrame:
    """The newest state of each path; paths that are gone stay known, so late events cannot bring them back."""
    newest = F.max(F.struct("ts", "event_id", "gone", "mtime_us")).alias("l")
    columns = ["path", "gone", "mtime_us", "ts", "event_id"]
    return table.select(columns).unionByName(states.select(columns)).groupBy("path").agg(newest).select("path", "l.gone", "l.mtime_us", "l.ts", "l.event_id")


def version(spark: SparkSession, table: str, number: int) -> DataFrame:
    """(path, mtime_us, ts, event_id) of the files that are there in a version."""
    return state_table(spark, table).read(number).where(~F.col("gone")).drop("gone")
