"""Inputs that queries derive from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import scratch as scratch


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: id, name, path, body, mtime_us, modified_at."""
    d = read(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    us = F.lit(1_704_067_200_000_000) + F.col("doc_id") * 3_600_000_000
    return d.select(F.col("doc_id").alias("id"), name.alias("name"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"), F.col("text").alias("body"), us.alias("mtime_us"), F.timestamp_micros(us).alias("modified_at"), "lang", "source")


DOCS = """(select doc_id as id, 'doc_' || doc_id || '.pdf' as name, '/' || source || '/' || lang || '/doc_' || doc_id || '.pdf' as path, text as body,
 1704067200000000 + doc_id * 3600000000 as mtime_us, make_timestamp(1704067200000000 + doc_id * 3600000000) as modified_at, lang, source from documents)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text as a query, up to the 200 characters that a query may have; every other one asks for recent documents."""
    words = F.substring("text", 1, 200)
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("최근 "), words)).otherwise(words).alias("query"))


RAW_QUERIES = """(select item_id as query_id, case when item_id % 2 = 0 then '최근 ' else '' end || substring(text, 1, 200) as query from benchmark)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label", (F.col("vec_id") % 20).alias("topic"))


VECTORS = "(select vec_id as id, embedding::double[] as v, label, vec_id % 20 as topic from embeddings)"
