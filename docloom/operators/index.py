"""Keeping a document table current: upserts, differences, failures, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import short_reason


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(existing: DataFrame, updates: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """existing with the latest update of each key put in.  Write the result to a new version of the table."""
    return existing.join(updates, key, "left_anti").unionByName(latest(updates, key, order).select(*existing.columns))


def index_diff(catalog: DataFrame, store: DataFrame) -> DataFrame:
    """catalog(id, mtime_us, ...) with state: skipped if the store holds the same time, else new or changed."""
    held = store.select("id", F.col("mtime_us").alias("__held"), F.lit(True).alias("__known"))
    state = F.when(F.col("__known").isNull(), "new").when(F.col("mtime_us") == F.col("__held"), "skipped").otherwise("changed")
    return catalog.join(held, "id", "left").withColumn("state", state).drop("__held", "__known")


def work_list(catalog: DataFrame, store: DataFrame) -> DataFrame:
    """What is to be embedded: no row whose id and time the store has."""
    return catalog.join(store.select("id", "mtime_us"), ["id", "mtime_us"], "left_anti")


def newest(catalog: DataFrame, most: int = 500) -> DataFrame:
    return catalog.orderBy(F.desc("mtime_us"), "id").limit(most)


def with_failures(rows: DataFrame, text_col: str = "normalized_text") -> DataFrame:
    """rows with status done or failed and reason: an error, or no text."""
    error = F.coalesce(F.col("error"), F.lit(""))
    empty = F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) == 0
    return rows.withColumn("status", F.when((error != "") | empty, "failed").otherwise("done")).withColumn("reason", F.when(error != "", short_reason(error)).when(empty, "empty_text").otherwise(""))


def index_report(rows: DataFrame, elapsed: float, running: bool = True) -> DataFrame:
    """One row from (status): total, done, skipped, failed, processed, and the seconds still to go."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = rows.agg(F.count("*").alias("total"), count("done"), count("skipped"), count("failed")).withColumn("processed", F.col("done") + F.col("skipped"))
    open_ = (F.col("processed") > 0) & (F.col("total") > F.col("processed")) & F.lit(running and elapsed > 1)
    return out.withColumn("eta_sec", F.when(open_, (F.col("total") - F.col("processed")) * elapsed / F.col("processed")))


def model_guard(store: DataFrame, model: str) -> DataFrame:
    """Rows of another embedding model count as absent."""
    return store.where(F.coalesce(F.col("embed_model"), F.lit("")) == model)


def needs_rebuild(store: DataFrame, model: str) -> DataFrame:
    return store.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col("embed_model"), F.lit("")) == model).alias("usable")).withColumn("rebuild", F.col("rows") != F.col("usable"))
