"""Checks of a labelled corpus, and how much signals say about its labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SKEW = 0.30


def distribution(rows: DataFrame, col: str, skew: float = SKEW) -> DataFrame:
    """(value, n, ratio, skewed), counted before the total is formed."""
    counts = rows.groupBy(F.col(col).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("__all")).alias("ratio"), (F.col("n") / F.col("__all") > skew).alias("skewed"))


def domain_check(rows: DataFrame, col: str, expected: DataFrame) -> DataFrame:
    """(value, problem): expected values that do not occur, and values that are not expected."""
    seen, wanted = rows.select(F.col(col).alias("value")).distinct(), expected.select(F.col(expected.columns[0]).alias("value")).distinct()
    return wanted.exceptAll(seen).withColumn("problem", F.lit("missing")).unionByName(seen.exceptAll(wanted).withColumn("problem", F.lit("unknown")))


def text_health(rows: DataFrame, text_col: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text_col), F.lit(""))
    return rows.withColumns({"mojibake": F.contains(t, F.lit("�")), "empty_text": F.length(F.regexp_replace(t, r"(?U)\s+", "")) == 0, "has_hangul": t.rlike("[가-힣]"), "text_length": F.length(t)})


def health_summary(rows: DataFrame, text_col: str = "text") -> DataFrame:
    return text_health(rows, text_col).agg(F.count("*").alias("n"), F.count_if("mojibake").alias("mojibake"), F.count_if("empty_text").alias("empty_text"), F.count_if("has_hangul").alias("hangul"), F.avg("text_length").alias("mean_length"))


def status_counts(rows: DataFrame, col: str = "status") -> DataFrame:
    return rows.groupBy(F.split_part(F.col(col), F.lit(":"), F.lit(1)).alias("status")).agg(F.count("*").alias("n"))


def entropy(rows: DataFrame, label: str) -> DataFrame:
    counts = rows.groupBy(label).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("__n"))
    share = F.col("c") / F.col("__n")
    return counts.join(F.broadcast(total)).agg((-F.sum(share * F.log2(share))).alias("entropy"))


def information_gain(rows: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """One row: H(label), H(label given keys), gain, its share, the majority rule's accuracy, and the number of groups."""
    return information_gains(rows, label, [keys])


def information_gains(rows: DataFrame, label: str, key_sets: list[list[str]]) -> DataFrame:
    """A row for each set of keys: signal, H(label), H(label given keys), gain, its share, the majority rule's accuracy, groups.

    The rows are read once, into counts by all keys and label, which Spark sums before it shuffles.  Every key set rolls those counts
    up, so what follows grows with the different values and not with the rows.  Null is a value.  At most 63 keys in all.
    """
    every = list(dict.fromkeys(k for keys in key_sets for k in keys))
    fine = rows.groupBy(*every, F.col(label).alias("__label")).agg(F.count("*").alias("c"))
    sets = [[*keys, "__label"] for keys in key_sets]
    # several sets of the same keys count once; a grouping id tells the sets apart, as null may be a value
    counts = fine.groupingSets([[F.col(k) for k in s] for s in {tuple(sorted(s)): s for s in sets}.values()], *every, "__label").agg(F.grouping_id().alias("__set"), F.sum("c").alias("c"))
    groups = counts.groupBy("__set", *every).agg(F.sum("c").alias("g"), F.max("c").alias("top"), F.sum(F.col("c") * F.log2("c")).alias("clogc"))
    # sum over a group of -c log2(c / g) is g log2 g - sum c log2 c
    inside = groups.groupBy("__set").agg(F.sum(F.col("g") * F.log2("g") - F.col("clogc")).alias("bits"), F.sum("top").alias("top"), F.sum("g").alias("n"), F.count("*").alias("groups"))
    some = F.min("__set").alias("__set")  # the labels' own counts follow from any of the sets
    one = counts.agg(some)
    labels = counts.join(F.broadcast(one), "__set").groupBy("__label").agg(F.sum("c").alias("c")).agg(F.sum("c").alias("ln"), F.sum(F.col("c") * F.log2("c")).alias("lclogc"))
    h = F.log2("ln") - F.col("lclogc") / F.col("ln")
    conditional = F.col("bits") / F.col("n")
    # bit k of the id, from the left, is set if the k-th key is summed over
    ids = [sum((k not in keys) << (len(every) - i) for i, k in enumerate(every)) for keys in key_sets]
    named = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("__set"), F.lit("+".join(keys)).alias("signal")) for i, keys in zip(ids, key_sets, strict=True))))
    inside = inside.withColumn("__n", named).where("__set = __n.__set")
    return inside.join(F.broadcast(labels)).select("__n.signal", h.alias("h_label"), conditional.alias("h_given"), (h - conditional).alias("gain"), F.when(h > 0, (h - conditional) / h).alias("gain_share"), (F.col("top") / F.col("n")).alias("ceiling"), "groups")


def cross_tab_purity(rows: DataFrame, a: str, b: str, label: str) -> DataFrame:
    out = rows.groupBy(a, b).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(label).cast("string"))), ",").alias("labels"), F.count_distinct(label).alias("kinds"))
    return out.withColumn("impure", F.col("kinds") > 1).drop("kinds")


def gate_metrics(status_col: str, text_col: str | None, domains: dict[str, list[str]]) -> list[Column]:
    """What the gate needs of the rows, as aggregates of a bounded size: counts, and for each declared column one count a value."""
    known = lambda c, values: [F.count_if(F.col(c) == v) for v in values]
    other = lambda c, values: F.count_if(~F.coalesce(F.col(c).isin(*values), F.lit(False)))
    broken = F.count_if(F.contains(text_col, F.lit("\ufffd"))) if text_col else F.lit(0).cast("long")
    counts = [F.array(*known(c, values), other(c, values)).alias(f"of_{c}") for c, values in domains.items()]
    return [F.count("*").alias("n"), F.count_if(F.col(status_col) == "success").alias("success"), F.count_if(F.col(status_col) == "ok").alias("odd"), broken.alias("mojibake"), *counts]


def gate_verdict(found: DataFrame, expected_rows: int, domains: dict[str, list[str]], closed: tuple[str, ...], skew: float) -> DataFrame:
    """(n, success, odd, mojibake, failures, passed) from one row of metrics; failures stand in the order of the rules."""
    failures = [F.when(F.col("n") != expected_rows, "row_count"), F.when(F.col("success") == 0, "no_success"), F.when(F.col("odd") > 0, "unexpected_status")]
    for c, values in domains.items():
        at = lambda k, c=c: F.col(f"of_{c}")[k]
        if c in closed:
            failures += [F.when(at(k) == 0, f"missing_{c}:{v}") for k, v in enumerate(values)] + [F.when(at(len(values)) > 0, f"unknown_{c}")]
        failures += [F.when(at(k) / F.nullif("n", F.lit(0)) > skew, f"skew_{c}:{v}") for k, v in enumerate([*values, "other"])]
    failures.append(F.when(F.col("mojibake") > 0, "replacement_characters"))
    out = found.withColumn("failures", F.filter(F.array(*failures), lambda x: x.isNotNull()))
    return out.withColumn("passed", F.size("failures") == 0).drop(*(f"of_{c}" for c in domains))


def dataset_gate(rows: DataFrame, expected_rows: int, status_col: str = "extraction_status", text_col: str | None = None, domains: dict[str, list[str]] | None = None, closed: tuple[str, ...] = ("category",), skew: float = SKEW) -> DataFrame:
    """One row: passed and the list of failures, all from one reading of the rows.

    domains names the values that a column may have.  In closed columns every one must occur and no other may; in any of them no
    value may hold more than skew of the rows.  Values that are not named, null too, count together as other.
    """
    domains = domains or {}
    return gate_verdict(rows.agg(*gate_metrics(status_col, text_col, domains)), expected_rows, domains, closed, skew)


def write_gated(rows: DataFrame, path: str, expected_rows: int, status_col: str = "extraction_status", text_col: str | None = None, domains: dict[str, list[str]] | None = None, closed: tuple[str, ...] = ("category",), skew: float = SKEW) -> DataFrame:
    """Write rows as Parquet and return the gate's row: its metrics are observed while the rows are written, not read again."""
    domains, seen = domains or {}, Observation()
    rows.observe(seen, *gate_metrics(status_col, text_col, domains)).write.mode("overwrite").parquet(path)
    schema = "n long, success long, odd long, mojibake long" + "".join(f", `of_{c}` array<long>" for c in domains)
    return gate_verdict(rows.sparkSession.createDataFrame([tuple(seen.get.values())], schema), expected_rows, domains, closed, skew)


def stable_sample(rows: DataFrame, index: str, n: int, seed: int = 42, order: str | None = None) -> DataFrame:
    """The last row of each index by order, and of these n in the order of the md5 of "index:seed".

    Both steps merge: maxima are formed before the shuffle, and each task hands on its first n.  Ties in order go to the row that
    is largest in its other columns, from left to right; without order that row is the one.
    """
    first = [order] if order else []
    rest = [c for c in rows.columns if c not in (index, *first)]
    last = rows.groupBy(index).agg(F.max(F.struct(*first, *rest)).alias("__l")) if first or rest else rows.distinct()
    drawn = last.orderBy(F.md5(F.concat(F.coalesce(F.col(index).cast("string"), F.lit("")), F.lit(f":{seed}"))), index).limit(n)
    return drawn.select(*(F.col(c) if c == index else F.col("__l")[c].alias(c) for c in rows.columns))
