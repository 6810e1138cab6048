"""Quality rules: base counts and robust multivariate outliers, in DataFrame expressions only.

Four ratios of a text, transformed so that clean texts of any length look alike, form a vector.  For every language and
source the minimum covariance determinant estimate is found by concentration steps from two starts: medians with median
deviations, and the classical mean and covariance.  Each step takes the 75 % of rows with the smallest Mahalanobis distance
for the next mean and covariance, until the determinants stay; the start with the least determinant is the group's.  A row
is rejected if its squared distance exceeds a quantile of chi-square.  A floor under the variances keeps groups without
spread regular.  Quantiles are taken of values on a fixed grid, so their state is bounded and does not depend on how rows
are spread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import WORD, key_of, settle

GAP = r"[\x20\x09-\x0D]"
FEATURES = ("f_length", "f_symbols", "f_lines", "f_repeats")
#: Standard deviations that any group has at least, by feature.
FLOORS = (0.08, 0.06, 0.08, 0.10)
SHARE, MOST_STEPS, SMALLEST_GROUP, SALTS = 0.75, 12, 50, 64
#: Squared distance over which a row is an outlier: 1 - 5e-6 quantile of chi-square with four degrees of freedom; and its median.
LIMIT, MEDIAN = 30.0, 3.357
#: Up to so many groups the estimates go to the rows by broadcast, beyond that by a salted join.
FEW_GROUPS = 5000


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Compute value once for a row and use it under a name."""
    return F.transform(F.array(value), then)[0]


def repeated_words(words: Column, width: int = 5) -> Column:
    """How many words stand in windows of width words that the text has twice or more."""

    def marked(hashes: Column) -> Column:
        def covered(s: Column) -> Column:
            same = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
            starts = F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
            return F.aggregate(starts, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")))["n"]

        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, covered)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
    return F.when(F.size(words) > width, let(windows, marked)).otherwise(F.lit(0).cast("long"))


def base_statistics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words; null texts count as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
        return let(
            lines,
            lambda lines: F.struct(
                F.size(words).cast("long").alias("n_words"),
                (F.length(text) - F.regexp_count(text, F.lit(GAP))).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                F.size(lines).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                repeated_words(words).alias("n_repeat_words"),
            ),
        )

    return let(F.array_remove(F.split(text, GAP + "+"), ""), counts)


def features(s: Callable[[str], Column]) -> list[Column]:
    """Transformed statistic vector.  Added constants draw short texts towards a clean text's values."""
    return [
        F.log((s("word_chars") + 100) / (s("n_words") + 20)),
        F.sqrt(s("n_symbols") / (s("word_chars") + 50)),
        F.sqrt(s("n_dup_lines") / (s("n_lines") + 10)),
        F.sqrt(s("n_repeat_words") / (s("n_words") + 50)),
    ]


def squared_distance(x: list[Column], mean: list[Column], low: dict[tuple[int, int], Column]) -> Column:
    """|L^-1 (x - mean)|^2 by forward substitution."""
    y: list[Column] = []
    for i, (a, m) in enumerate(zip(x, mean, strict=True)):
        y.append((a - m - sum((low[i, j] * y[j] for j in range(i)), F.lit(0.0))) / low[i, i])
    return sum((v * v for v in y), F.lit(0.0))


def per_group(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """rows with what table has of their group.

    few: a group has one row in table and there are at most 2 * FEW_GROUPS.  Else rows carry a salt and table has a copy for
    each, so a hot group is spread.
    """
    if few:
        return rows.join(F.broadcast(table), "group")
    return rows.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge"), ["group", "salt"])


def on_grid(value: Column, steps: int) -> Column:
    return F.round(value * steps).cast("int")


def estimates(rows: DataFrame, near: Column) -> DataFrame:
    """By group: mean m0.. and lower Cholesky factor l00.. of the rows that are near, and half the logarithm of its determinant."""
    k = len(FEATURES)
    sums = [F.avg(F.when(near, F.col(f))).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    sums += [F.avg(F.when(near, F.col(FEATURES[i]) * F.col(FEATURES[j]))).alias(f"s{i}{j}") for i in range(k) for j in range(i + 1)]
    out = rows.groupBy("group").agg(*sums)
    for i in range(k):
        for j in range(i + 1):
            cov = F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
            rest = cov - sum((F.col(f"l{i}{q}") * F.col(f"l{j}{q}") for q in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}{j}"))
    determinant = sum((F.log(F.col(f"l{i}{i}")) for i in range(k)), F.lit(0.0))
    return out.select("group", determinant.alias("determinant"), *(f"m{i}" for i in range(k)), *(f"l{i}{j}" for i in range(k) for j in range(i + 1)))


def distances(rows: DataFrame, fitted: DataFrame, few: bool) -> DataFrame:
    """rows with d2, the squared distance to its group's estimate."""
    k = len(FEATURES)
    joined = per_group(rows, fitted, few)
    d2 = squared_distance([F.col(f) for f in FEATURES], [F.col(f"m{i}") for i in range(k)], {(i, j): F.col(f"l{i}{j}") for i in range(k) for j in range(i + 1)})
    return joined.withColumn("d2", d2).select(*rows.columns, "d2")


def cut_at(rows: DataFrame, share: float, few: bool) -> DataFrame:
    """rows with near: whether d2 is within that share of its group's smallest."""
    cut = rows.groupBy("group").agg(F.percentile(on_grid(F.log(F.col("d2") + 1e-6), 64), F.lit(share)).alias("cut"))
    return per_group(rows, cut, few).withColumn("near", on_grid(F.log(F.col("d2") + 1e-6), 64) <= F.col("cut"))


def by_medians(stats: DataFrame, few: bool) -> DataFrame:
    """stats with d2, the squared distance from the medians in median deviations."""
    medians = stats.groupBy("group").agg(*(F.percentile(on_grid(F.col(f), 1024), F.lit(0.5)).alias(f"c{i}") for i, f in enumerate(FEATURES)))
    centred = per_group(stats, medians, few)
    spread = centred.groupBy("group").agg(*(F.percentile(F.abs(on_grid(F.col(f), 1024) - F.col(f"c{i}")).cast("int"), F.lit(0.5)).alias(f"v{i}") for i, f in enumerate(FEATURES)))
    d2 = sum((F.pow((F.col(f) - F.col(f"c{i}") / 1024) / F.greatest(F.col(f"v{i}") * 1.4826 / 1024, F.lit(FLOORS[i])), 2) for i, f in enumerate(FEATURES)), F.lit(0.0))
    return per_group(centred, spread, few).withColumn("d2", d2).select(*stats.columns, "d2")


def least_determinant(stats: DataFrame, share: float, most_steps: int, few: bool) -> DataFrame:
    """The estimate of each group, from the start whose determinant ends lowest."""
    slim = stats.select("group", "salt", *FEATURES)
    started = lambda rows, k: rows.withColumn("group", F.concat("group", F.lit(f"\x1e{k}")))
    twice = started(slim, 0).unionByName(started(slim, 1))
    classical = estimates(slim, F.lit(True))
    rows, before = started(by_medians(slim, few), 0).unionByName(started(distances(slim, classical, few), 1)), None
    for _ in range(most_steps):
        fitted = settle(estimates(near := cut_at(rows, share, few), near["near"]))
        now = fitted.agg(F.sum("determinant")).first()[0]
        if now is None or before is not None and abs(before - now) < 1e-6:
            break
        before, rows = now, distances(twice, fitted, few)
    base = F.substring_index("group", "\x1e", 1)
    best = fitted.groupBy(base.alias("base")).agg(F.min(F.struct("determinant", F.struct(*(c for c in fitted.columns if c not in ("group", "determinant"))).alias("e"))).alias("b"))
    return settle(best.select(F.col("base").alias("group"), "b.e.*"))


def outliers(stats: DataFrame, limit: float = LIMIT, share: float = SHARE, most_steps: int = MOST_STEPS) -> DataFrame:
    """Rows (group and the features, other columns stay) with d2 and outlier."""
    if "salt" not in stats.columns:
        stats = stats.withColumn("salt", F.pmod(F.xxhash64(*FEATURES), F.lit(SALTS)).cast("int"))
    few = stats.select("group").distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    rows = distances(stats, least_determinant(stats, share, most_steps, few), few)
    scale = rows.groupBy("group").agg(F.greatest(F.exp(F.percentile(on_grid(F.log(F.col("d2") + 1e-6), 64), F.lit(0.5)) / 64) / MEDIAN, F.lit(1.0)).alias("scale"))
    return per_group(rows, scale, few).withColumn("d2", F.col("d2") / F.col("scale")).withColumn("outlier", F.col("d2") > limit).drop("scale")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limit: float = LIMIT) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, outlier_distance, kept.

    Groups are language and source, null being a value of its own; groups under 50 rows are pooled by language, and then
    overall.  Null and empty texts have no word and fail the base rule.  Rows that fail it take no part in the estimates
    and have no distance.  Repeated rows count each.
    """
    s = lambda c: F.col(f"s.{c}")
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    counted = docs.select(F.col(id_col).alias("id"), key_of(F.col(lang_col)).alias("l"), key_of(F.col(source_col)).alias("src"), base_statistics(F.col(text_col)).alias("s"))
    counted = settle(counted.select("id", "l", "src", *(s(c).alias(c) for c in names)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    passing = counted.where(~F.col("base_failed"))
    sizes = passing.groupBy("l", "src").agg(F.count("*").alias("n"))
    pooled = sizes.groupBy("l").agg(F.sum(F.when(F.col("n") < SMALLEST_GROUP, F.col("n")).otherwise(0)).alias("rest"))
    sizes = sizes.join(pooled, "l").select("l", "src", F.when(F.col("n") >= SMALLEST_GROUP, F.concat_ws("\x1f", "l", "src")).when(F.col("rest") >= SMALLEST_GROUP, F.col("l")).otherwise("").alias("group"))
    salted = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    spread = sizes.withColumn("sizes_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    vectors = passing.withColumn("sizes_salt", salted).join(spread.hint("merge"), ["l", "src", "sizes_salt"]).withColumns(dict(zip(FEATURES, features(F.col), strict=True)))
    columns = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    salt = F.pmod(F.xxhash64("id", *FEATURES), F.lit(SALTS)).cast("int").alias("salt")
    judged = outliers(settle(vectors.select("group", salt, *columns, *FEATURES)), limit).select(*columns, F.col("d2").alias("outlier_distance"), (~F.col("outlier")).alias("kept"))
    rest = counted.where("base_failed").select(*columns, F.lit(None).cast("double").alias("outlier_distance"), F.lit(False).alias("kept"))
    return judged.unionByName(rest).withColumnRenamed("id", id_col)


def op4_mcd_quality(spark, sf_dir):
    from docloom.llm.shared import read

    return quality(read(spark, sf_dir, "documents"))
