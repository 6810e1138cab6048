"""Classification and example retrieval over vectors.

Documents, examples and labels carry unit vectors as arrays.  Labels and queries are the small side, checked before they
are broadcast; neighbours come from the module nearest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import let
from docloom.lexicon import CATEGORIES, EXAMPLE_THRESHOLD, LABEL_THRESHOLD, NEIGHBOURS
from docloom.operators.nearest import BLOCK, nearest
from docloom.operators.retrieve import checked, dot


def l2_normalize(v: Column) -> Column:
    """v over its length, which counts 1e-9 at least."""
    size = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-9))
    return F.transform(v, lambda x: x / size)


def zero_shot(docs: DataFrame, labels: DataFrame, threshold: float = LABEL_THRESHOLD) -> DataFrame:
    """docs(id, v), labels(label, lv) to (id, category, confidence, method): the nearest label if near enough, else etc."""
    sims = docs.select("id", "v").join(checked(labels, 1000)).select("id", "label", dot(F.col("v"), F.col("lv")).alias("sim"))
    best = sims.groupBy("id").agg(F.max(F.struct(F.col("sim"), F.struct(F.col("label")).alias("l"))).alias("b")).select("id", F.col("b.l.label").alias("label"), F.col("b.sim").alias("confidence"))
    near = F.col("confidence") >= threshold
    return best.select("id", F.when(near, F.col("label")).otherwise("etc").alias("category"), "confidence", F.when(near, "label_zeroshot").otherwise("etc_fallback").alias("method"))


def majority(votes: DataFrame, keys: list[str], label: str, place: str) -> DataFrame:
    """Most frequent label of each key; ties go to the label that comes first by place.  Also winner's votes and all votes."""
    counted = votes.groupBy(*keys, label).agg(F.count("*").alias("votes"), F.min(place).alias("__first"), F.max("sim").alias("best"))
    ranked = counted.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "__first"))).withColumn("of", F.sum("votes").over(Window.partitionBy(*keys)))
    return ranked.where("__r = 1").select(*keys, label, "votes", "of", "best")


def user_knn_vote(docs: DataFrame, examples: DataFrame, k: int = NEIGHBOURS, threshold: float = EXAMPLE_THRESHOLD) -> DataFrame:
    """examples(eid, ev, category): the k nearest, of those the near and valid ones, their majority and its confidence."""
    top = nearest(docs.select("id", "v"), examples, k).where(F.col("sim") >= threshold).join(examples.select("eid", "category").hint("merge"), "eid").where(F.col("category").isin(*CATEGORIES))
    won = majority(top, ["id"], "category", "place")
    return won.select("id", "category", F.least(F.lit(1.0), F.col("best") * F.col("votes") / F.col("of")).alias("confidence"), F.lit("user_knn").alias("method"))


def classify_cascade(docs: DataFrame, labels: DataFrame, examples: DataFrame) -> DataFrame:
    """The user's examples decide if any is near; else label definitions; else etc."""
    first = user_knn_vote(docs, examples).select("id", F.struct("category", "confidence", "method").alias("a"))
    second = zero_shot(docs, labels).select("id", F.struct("category", "confidence", "method").alias("b"))
    return second.join(first.hint("merge"), "id", "left").select("id", F.coalesce("a", "b").alias("c")).select("id", "c.*")


def retrieve_context(docs: DataFrame, examples: DataFrame, k: int = NEIGHBOURS, most_examples: int = 3) -> DataFrame:
    """docs(id, name, v), examples(eid, name, category, ideal_filename, document, ev): votes and examples from one lookup.

    Neighbours of the same name and of unknown category are left out after the lookup, so fewer may remain.
    """
    want = min(max(most_examples, k) * 2, 10)
    top = nearest(docs.select("id", "v"), examples, want).join(examples.drop("ev").hint("merge"), "eid").join(docs.select("id", F.col("name").alias("own")).hint("merge"), "id")
    valid = top.where((F.col("name") != F.col("own")) & F.col("category").isin(*CATEGORIES))
    valid = valid.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("place")))
    won = majority(valid.where(F.col("n") <= k), ["id"], "category", "n").select("id", F.col("category").alias("knn_category"), (F.col("votes") / F.col("of")).alias("vote_ratio"))
    example = F.struct("n", F.coalesce("ideal_filename", "name").alias("file_name"), "category", F.substring("document", 1, 2000).alias("first_page_text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "sim")).alias("score"))
    shown = valid.where(F.col("n") <= most_examples).groupBy("id").agg(F.array_sort(F.collect_list(example)).alias("e"))
    return shown.join(won.hint("merge"), "id", "left").select("id", F.transform("e", lambda x: x.dropFields("n")).alias("examples"), "knn_category", "vote_ratio")


def knn_leave_one_out(vectors: DataFrame, ks: tuple[int, ...] = (1, 3, 5), block: int = BLOCK) -> DataFrame:
    """vectors(id, topic, label, v) to (id, label, k, predicted): neighbours of the same topic do not count."""
    top = nearest(vectors.select("id", "topic", "v"), vectors.select(F.col("id").alias("eid"), "topic", F.col("v").alias("ev")), max(ks), block)
    top = top.join(vectors.select(F.col("id").alias("eid"), F.col("label").alias("elabel")).hint("merge"), "eid")
    top = top.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("place") <= F.col("k"))
    won = majority(top, ["id", "k"], "elabel", "place")
    return vectors.select("id", "label").join(won.hint("merge"), "id").select("id", "label", "k", F.col("elabel").alias("predicted"))


def hashed_vectors(docs: DataFrame, id_col: str, text_col: str, size: int = 64) -> DataFrame:
    """(id, v): a deterministic stand-in for a model, counts of hashed runs of three characters at unit length.

    The lower-cased text stands between two spaces; of a run a, b, c the bucket is ((7919 a + b) 104729 + c) mod 1000003 mod size, in
    code points.  Runs are counted by id and bucket before anything is shuffled, so a text of any length moves as size counts.
    Null and empty texts give zeros; texts that share an id count together.
    """
    # each run is a row of its own from the start: then all of it is compiled code, which lambdas over arrays are not
    code = lambda k: F.ascii(F.get("__c", F.col("__i") + k)).cast("long")
    hashed = F.when(F.col("__i").isNotNull(), F.pmod((code(0) * 7919 + code(1)) * 104729 + code(2), F.lit(1_000_003)) % size)
    letters = docs.select(id_col, F.split(F.concat(F.lit(" "), F.lower(text_col), F.lit(" ")), "").alias("__c"))
    runs = letters.select(id_col, "__c", F.explode_outer(F.when(F.size("__c") > 2, F.sequence(F.lit(0), F.size("__c") - 3))).alias("__i"))
    counts = runs.select(id_col, hashed.alias("__b")).groupBy(id_col, "__b").agg(F.count("*").cast("double").alias("__n"))
    by = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.when(F.col("__b").isNotNull(), F.struct("__b", "__n")))).alias("__m"))
    length = F.greatest(F.sqrt(F.aggregate(F.map_values("__m"), F.lit(0.0), lambda a, x: a + x * x)), F.lit(1e-9))
    places = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    return by.select(id_col, let(length, lambda size_of: F.transform(places, lambda k: F.coalesce(F.try_element_at("__m", k), F.lit(0.0)) / size_of)).alias("v"))


def isolated(embedder: Callable[[pd.Series], pd.Series], texts: pd.Series) -> tuple[list, list[str]]:
    """Vectors and errors of a batch.  A batch that fails is halved until the bad texts stand alone: one costs 2 log2(n) more calls."""
    vectors, errors, todo = [None] * len(texts), [""] * len(texts), [(0, len(texts))] if len(texts) else []
    while todo:
        a, b = todo.pop()
        try:
            got = list(embedder(texts.iloc[a:b]))
            if len(got) != b - a:
                raise ValueError(f"{len(got)} vectors for {b - a} texts")
            vectors[a:b] = got
        except Exception as error:  # whatever a model throws is a row's error, not the end of the job
            if b - a == 1:
                errors[a] = f"{type(error).__name__}: {error}"
            else:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
    return vectors, errors


def embed(docs: DataFrame, text_col: str, embedder: Callable[[pd.Series], pd.Series], out: str = "v", error: str = "error") -> DataFrame:
    """docs with a vector from any batch embedder, and an error, empty where there is none; texts reach it in Arrow batches.

    A text that the embedder fails on has a null vector and its error; all others of its batch have their vectors.
    """

    @F.pandas_udf("v array<float>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, errors = isolated(embedder, batch)
            yield pd.DataFrame({"v": pd.Series(vectors, dtype=object), "error": pd.Series(errors, dtype=object)})

    return docs.withColumn("__e", run(F.col(text_col))).withColumns({out: F.col("__e.v"), error: F.col("__e.error")}).drop("__e")
