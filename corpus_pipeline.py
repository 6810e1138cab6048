"""A corpus pipeline: toxic documents and bad ones go, near copies are thinned, sources are mixed, and texts are encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, mixing, quality_rules, simhash, toxicity
from docloom.llm.shared import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __key: a hash of id and text, so that rows that share an id are told apart.  Null and empty differ."""
    return docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.col("text").isNull(), "text"))


def clean_of_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on what it is given, does not reject.

    Null and empty texts are not toxic and stay.  Whole texts are read, however long.  Repeated rows and rows that share an id are
    judged each by their text.  Other columns than those of documents are dropped.  An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs.select(*COLUMNS), toxicity.train(docs, labels))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source.

    Null and empty texts have no word and go.  Null languages and sources are groups of their own.  Equal rows are all kept or
    all go; rows that share an id are judged each.  Clashing columns are dropped.  An empty table stays empty.
    """
    docs = keyed(docs.select(*COLUMNS))
    kept = quality_rules.quality(docs, id_col="__key").where("kept").select("__key").distinct()
    return docs.join(kept.hint("merge"), "__key", "left_semi").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles alike by 0.8 or more, over any path.

    The row with the least id stays, null ids last; of repeated rows one.  Null, empty and wordless texts are one group.
    Clashing columns are dropped.  An empty table stays empty.
    """
    return simhash.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files that follow one another in the order of the mix.

    Null sources are a source.  Ties and repeated rows keep a place each.  Clashing columns are dropped.  Empty stays empty.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixing.mix(docs.select(*COLUMNS)).repartitionByRange(parts, "position").sortWithinPartitions("position").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of decoded texts, by document.

    Null and empty texts have no token and the digest of nothing.  Whole texts are encoded, however long; repeated rows each.
    """
    return bpe.encode_decode(docs)


STAGES = [("toxicity", clean_of_toxic), ("quality", of_quality), ("near_dedup", one_of_each), ("mixing", mixed), ("bpe", encoded)]

#: The classifier, the determinant search and the tokenizer have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to documents.  Between stages rows are kept as Parquet in the shared folder."""
    place, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{place}/{k}-{name}")
            docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
