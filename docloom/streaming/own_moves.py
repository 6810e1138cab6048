"""Following file changes while the records of one's own moves come in at any time, also after the changes that they explain.

A watcher sees a move's changes at once, but the record of the move may be written later.  So what an event says of its path goes into
the table at once, and a record that comes later takes it back: the path gets the state that it had without that event.

The table in versions holds the state itself, a row each: the events of the last while that no record explains, the records of that while,
and by path the newest older event.  A batch puts its rows beside those of the buckets that it touches; records meet events by path and
slot of time, so a busy path fills several tasks.  What is old enough by its arrival is folded whenever its bucket is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import settle
from docloom.sources.versions import VersionedTable
from docloom.streaming.changes import steps

STATE = "path string, kind string, ts_us long, event_id long, gone boolean, mtime_us long, seen_ms long"
COLUMNS = [c.split()[0] for c in STATE.split(", ")]
RECORD = "path string, applied_at timestamp"


def arrivals(events: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of STATE, of kind event and record, from a stream of events and one of records(path, applied_at).

    A record stands for one path that a move of one's own touches; a move has one for its old and one for its new path.  Rows
    without path, time or, for events, event_id say nothing of any file and are left out.  seen_ms is the time of the batch.
    """
    changes = steps(events).where("path is not null and ts is not null and event_id is not null").withColumns({"kind": F.lit("event"), "ts_us": F.unix_micros("ts")})
    own = records.where("path is not null and applied_at is not null").withColumns({"kind": F.lit("record"), "ts_us": F.unix_micros("applied_at")})
    own = own.withColumns({"event_id": F.lit(None).cast("long"), "gone": F.lit(None).cast("boolean"), "mtime_us": F.lit(None).cast("long")})
    return changes.select(COLUMNS[:-1]).unionByName(own.select(COLUMNS[:-1])).withColumn("seen_ms", F.unix_millis(F.current_timestamp()))


def folded(rows: DataFrame, before_ms: int) -> DataFrame:
    """rows of STATE without repeats; of events seen before that time only the newest of a path stays, settled, and such records go."""
    old = F.coalesce(F.col("seen_ms") < before_ms, F.lit(False))
    rows = rows.where(~(old & (F.col("kind") == "record")))
    settled = old | (F.col("kind") == "settled")
    rows = rows.withColumns({"kind": F.when(settled, "settled").otherwise(F.col("kind")), "seen_ms": F.when(~settled, F.col("seen_ms"))})
    # of repeats the one seen last; of settled events, which have no such time, the newest
    each = F.when(F.col("kind") != "settled", F.struct("ts_us", "event_id", "gone")).alias("each")
    last = F.max(F.struct("seen_ms", "ts_us", "event_id", "gone", "mtime_us")).alias("l")
    return rows.groupBy("path", "kind", each).agg(last).select("path", "kind", "l.*").select(COLUMNS)


def unexplained(rows: DataFrame, seconds: int) -> DataFrame:
    """rows of STATE without the events that a record of their path within seconds explains."""
    band = seconds * 1_000_000
    width = max(band, 1)
    slot = lambda us: us - F.pmod(us, F.lit(width))
    # what an event has to know of the records: is one in its slot, the last one of the slot before, the first one of the next
    records = rows.where("kind = 'record'").select("path", F.col("ts_us").alias("at"), F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("to"))
    of = lambda k: F.when(F.col("to") == k, F.col("at"))
    near = records.groupBy("path", (slot(F.col("at")) + F.col("to") * width).alias("slot")).agg(F.max(of(0)).isNotNull().alias("same"), F.max(of(1)).alias("before"), F.min(of(-1)).alias("after"))
    explained = F.col("same") | (F.col("before") >= F.col("ts_us") - band) | (F.col("after") <= F.col("ts_us") + band)
    events = rows.where("kind = 'event'").withColumn("slot", slot(F.col("ts_us"))).join(near.hint("merge"), ["path", "slot"], "left")
    return rows.where("kind <> 'event'").unionByName(events.where(~F.coalesce(explained, F.lit(False))).select(COLUMNS))


def merged(seconds: int, keep_ms: int) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The state of buckets after one batch's rows, which were all seen at one time."""

    def merge(table: DataFrame, changes: DataFrame) -> DataFrame:
        now = changes.agg(F.max("seen_ms")).first()[0]
        return unexplained(settle(folded(table.select(COLUMNS).unionByName(changes.select(COLUMNS)), now - keep_ms)), seconds)

    return merge


def table_of(spark: SparkSession, table: str) -> VersionedTable:
    return VersionedTable(spark, table, STATE, "path")


def follow(spark: SparkSession, source: str, schema: str, records: str, table: str, checkpoint: str, seconds: int = 10, keep: int = 3600, files_per_batch: int | None = None) -> int:
    """Run what there is of a folder of event files and one of record files into versions of a table.  Returns the last version, or -1.

    An event and a record of its path within seconds of it give the same table whichever comes first, if the later one comes at most keep
    seconds after the earlier one.  After that an event is settled: a record changes it no more, and a record is forgotten.  Both folders
    must exist.  Repeated rows change nothing, and a batch that runs twice writes the same rows again.
    """
    options = {"maxFilesPerTrigger": files_per_batch} if files_per_batch else {}
    read = lambda form, path: spark.readStream.schema(form).options(**options).parquet(path)
    held, merge = table_of(spark, table), merged(seconds, keep * 1000)

    def batch(rows: DataFrame, number: int) -> None:
        held.commit(rows, merge, number)

    out = arrivals(read(schema, source), read(RECORD, records))
    out.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return held.last()


def version(spark: SparkSession, table: str, number: int) -> DataFrame:
    """(path, mtime_us, ts, event_id) of the files that are there in a version.

    Of events at one time the larger event_id is newer, and of a move onto its own path the delete.
    """
    newest = F.max(F.struct("ts_us", "event_id", "gone", "mtime_us")).alias("l")
    last = table_of(spark, table).read(number).where("kind <> 'record'").groupBy("path").agg(newest).where(~F.col("l.gone"))
    return last.select("path", "l.mtime_us", F.timestamp_micros("l.ts_us").alias("ts"), "l.event_id")
