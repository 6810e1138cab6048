"""Measuring retrieval, classification and file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import filename_tokens
from docloom.lexicon import FOLDER_ALIASES
from docloom.operators.suggest import lookup


def retrieval_metrics(hits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """hits(query_id, rank, topic), queries(query_id, topic_title, difficulty, ...): one row a query, also without hits."""
    joined = queries.join(hits.where(F.col("rank") <= k), "query_id", "left").withColumn("__hit", F.col("topic") == F.col("topic_title"))
    keys = [c for c in queries.columns]
    first = F.min(F.when(F.col("__hit"), F.col("rank")))
    out = joined.groupBy(*keys).agg(first.alias("first_rank"), F.count_if(F.coalesce("__hit", F.lit(False))).alias("relevant"))
    return out.withColumns({"hit_at_1": F.coalesce((F.col("first_rank") == 1).cast("int"), F.lit(0)), "hit_at_k": F.col("first_rank").isNotNull().cast("int"), "reciprocal_rank": F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))})


def metrics_by_difficulty(metrics: DataFrame, k: int) -> DataFrame:
    """Per difficulty and overall (null): n, Top-1, recall, MRR, precision (over k), median latency if there is one."""
    more = [F.median("elapsed_ms").alias("median_ms")] if "elapsed_ms" in metrics.columns else []
    return metrics.rollup("difficulty").agg(F.count("*").alias("n"), F.avg("hit_at_1").alias("top1"), F.avg("hit_at_k").alias("recall"), F.avg("reciprocal_rank").alias("mrr"), F.avg(F.col("relevant") / k).alias("precision"), *more)


def accuracy_report(pairs: DataFrame) -> DataFrame:
    """pairs(truth, predicted): correct, total and accuracy by class and overall (null)."""
    return pairs.rollup("truth").agg(F.count_if(F.col("truth") == F.col("predicted")).alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.col("correct") / F.col("total"))


def confusions(pairs: DataFrame, most: int = 5) -> DataFrame:
    wrong = pairs.where(F.col("truth") != F.col("predicted")).groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "truth", "predicted").limit(most)


def threshold_deciles(sims: DataFrame) -> DataFrame:
    """sims(kind, sim): first decile, median and ninth decile by kind, with exclusive quantiles.

    Places come from counts by value: the distinct similarities on a grid of 1e-9, summed in two steps, so no group of
    rows is sorted in one task.
    """
    counts = sims.groupBy("kind", F.round("sim", 9).alias("sim")).agg(F.count("*").alias("c"))
    bucket = F.floor(F.col("sim") * 1024)
    inner = Window.partitionBy("kind", "__b").orderBy("sim").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy("kind").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__b", bucket)
    buckets = counts.groupBy("kind", "__b").agg(F.sum("c").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(outer), F.lit(0)))
    totals = counts.groupBy("kind").agg(F.sum("c").alias("__n"))
    upto = counts.withColumn("__in", F.sum("c").over(inner)).join(buckets, ["kind", "__b"]).join(totals, "kind")
    last = F.col("__before") + F.col("__in")
    first = last - F.col("c") + 1

    def quantile(p: float) -> Column:
        at = F.lit(p) * (F.col("__n") + 1)
        low = F.least(F.greatest(F.floor(at), F.lit(1)), F.greatest(F.col("__n") - 1, F.lit(1)))
        value = lambda place: F.max(F.when((first <= place) & (place <= last), F.col("sim")))
        part = F.max(at - low)
        a, b = value(low), value(F.least(low + 1, F.col("__n")))
        return a + (b - a) * part

    return upto.groupBy("kind").agg(F.max("__n").alias("n"), quantile(0.1).alias("low_decile"), quantile(0.5).alias("median"), quantile(0.9).alias("high_decile"))


def filename_components(rows: DataFrame) -> DataFrame:
    """rows(predicted, course, topic_title, doc_type, semester, extension): five checks and their mean."""
    p = F.col("predicted")
    bare = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    checks = {
        "has_course": F.contains(p, F.col("course")),
        "has_topic": F.exists(F.split("topic_title", r"(?U)\s+"), lambda w: (F.length(w) > 1) & F.contains(p, w)),
        "has_doc_type": F.contains(F.replace(bare(p), F.lit("_"), F.lit("")), bare(F.col("doc_type"))),
        "has_semester": F.contains(p, F.col("semester")),
        "has_extension": F.endswith(F.lower(p), F.concat(F.lit("."), F.col("extension"))),
    }
    return rows.withColumns(checks).withColumn("filename_score", sum((F.col(c).cast("int") for c in checks), F.lit(0)) / len(checks))


def token_f1(predicted: Column, ideal: Column) -> Column:
    p, g = filename_tokens(predicted), filename_tokens(ideal)
    both = F.size(F.array_intersect(p, g))
    return F.when(both > 0, 2.0 * both / (F.size(p) + F.size(g))).otherwise(0.0)


def model_summary(runs: DataFrame) -> DataFrame:
    """runs(model, category_correct, json_valid, elapsed_sec, filename_score, filename_token_f1): one row a model.

    Scores average over the rows that have one, 0 if none has.
    """
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return runs.groupBy("model").agg(F.count("*").alias("n"), (F.sum("category_correct") / F.count("*")).alias("category_accuracy"), mean("filename_score"), mean("filename_token_f1"), (F.sum("json_valid") / F.count("*")).alias("json_valid_rate"), F.avg("elapsed_sec").alias("avg_sec"))


def pick_best(summary: DataFrame) -> DataFrame:
    order = F.struct((F.col("category_accuracy") + F.col("filename_score")), F.col("json_valid_rate"), -F.col("avg_sec"), F.col("model"))
    return summary.agg(F.max_by("model", order).alias("best"))


def run_summary(runs: DataFrame, most: int = 4) -> DataFrame:
    """runs(run, model, is_correct, json_valid, elapsed_sec, predicted, error): rates, top predictions and errors."""
    keys = ["run", "model"]
    base = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("is_correct").alias("correct"), F.sum("json_valid").alias("valid"), F.avg("elapsed_sec").alias("avg_sec"))

    def ranked(col: str, keep: int | None, out: str) -> DataFrame:
        c = runs.where(F.coalesce(F.col(col), F.lit("")) != "").groupBy(*keys, col).agg(F.count("*").alias("c"))
        c = c.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("c"), col)))
        c = c.where(F.col("r") <= keep) if keep else c
        return c.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws("=", col, "c").alias("t")))), lambda x: x["t"]), ", ").alias(out))

    return base.join(ranked("predicted", most, "top_predictions"), keys, "left").join(ranked("error", None, "errors"), keys, "left")


def baselines(rows: DataFrame, label: str) -> DataFrame:
    counts = rows.groupBy(label).agg(F.count("*").alias("c"))
    return counts.agg((F.max("c") / F.sum("c")).alias("majority"), (1.0 / F.count("*")).alias("random"), F.count("*").alias("classes"))


def folder_truth(files: DataFrame, path_col: str = "path") -> DataFrame:
    """files with truth: the category that the parent folder's name stands for, null if none."""
    folder = F.lower(F.element_at(F.split(path_col, "/"), -2))
    return files.withColumn("truth", lookup(FOLDER_ALIASES, folder))


def acceptable_top1(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query_id, acceptable array): is the first hit's category among them."""
    top = hits.where("rank = 1").select("query_id", "category")
    return queries.join(top, "query_id", "left").withColumn("hit", F.coalesce(F.array_contains("acceptable", F.col("category")), F.lit(False)).cast("int"))
