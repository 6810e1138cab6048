"""Filter interaction audit: what each filter removes, in every order of the filters.

Documents are first counted into cells: by part and by the mask of the filters they fail.  Then a recursive CTE enumerates the
orders.  It starts with an empty prefix for each part, and every level extends each prefix by each unused letter, joins the
part's mask cells and carries the bits that are already applied; the level's row holds that step's metrics.  Costs after the
counting depend on the number of parts alone: 325 prefixes a part.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import settle

SPACE_RUN = r"[\x20\x09-\x0D]+"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_rules(text: Column) -> dict[str, Column]:
    """The failure conditions that look at one text: letter to boolean column.  text must not be null."""
    words = F.array_remove(F.split(text, SPACE_RUN), "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * capitals > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masked(docs: DataFrame, rules: Mapping[str, Column], repeat_letter: str | None, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask): one row per document, bit k of mask set if it fails the k-th filter.

    The last filter, repeat_letter, fails a text that some smaller id has too.  Only digests of texts are shuffled, and only those
    that occur twice meet the others.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bits = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(rules.values())), F.lit(0))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), part.alias("part"), bits.cast("int").alias("mask"), F.sha2(text.cast("binary"), 256).alias("h"))
    if not repeat_letter:
        return rows.drop("h")
    rows = settle(rows)
    least = rows.groupBy("h").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("h", "least")
    again = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    return rows.join(least.hint("merge"), "h", "left").select("id", "part", (F.col("mask") + F.when(again, 1 << len(rules)).otherwise(0)).cast("int").alias("mask"))


def cells_of(rows: DataFrame, labels: DataFrame, id_col: str, n_filters: int) -> DataFrame:
    """(part, docs, good, toxic): one row per part with an array of counts by mask."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # few rows: counts by part, mask and labels
    counts = rows.join(marks.hint("merge"), "id", "left").groupBy("part", "mask").agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("docs", "good", "toxic"))))
    cells = counts.groupBy("part").agg(by_mask.alias("m"))
    return cells.select("part", *(F.expr(f"transform(sequence(0, {(1 << n_filters) - 1}), k -> coalesce(m[k].{c}, 0L))").alias(c) for c in ("docs", "good", "toxic")))


def orders(cells: DataFrame, letters: str) -> DataFrame:
    """Every order of letters by part, a row a step, from arrays of counts by mask."""
    spark, n = cells.sparkSession, len(letters)
    bits = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << k})" for k, x in enumerate(letters))
    masks = f"sequence(0, {(1 << n) - 1})"

    def total(counts: str, condition: str) -> str:
        """Sum of counts over the masks m with condition; s is the step's bit, a what was applied before."""
        return f"aggregate({masks}, 0L, (sum, m) -> sum + if({condition.replace('$a', 'applied').replace('$s', 'l.bit')}, {counts}[m], 0L))"

    def out(counts: str) -> str:
        return total(counts, "(m & $a) = 0 and (m & $s) <> 0")

    step = {
        "kept": total("docs", "(m & ($a | $s)) = 0"), "removed": out("docs"), "redundant": total("docs", "(m & $a) <> 0 and (m & $s) <> 0"),
        "unique_fails": total("docs", "m = $s"), "good_lost": out("good"), "toxic_lost": out("toxic"),
    }
    metrics = ", ".join(f"'{k}', {v}" for k, v in step.items())
    kind = "array<struct<" + ",".join(["step:int", "letter:string", *(f"{m}:bigint" for m in METRICS)]) + ">>"
    return spark.sql(
        f"""
        with recursive walk(part, prefix, applied, trail) as (
            select part, '', 0, cast(array() as {kind}) from {{cells}}
            union all
            select part, concat(prefix, l.letter), applied | l.bit, concat(trail, array(named_struct('step', length(prefix) + 1, 'letter', l.letter, {metrics})))
            from (
                select /*+ merge(c) */ w.*, c.docs, c.good, c.toxic
                from (select *, explode(filter(array({bits}), x -> (x.bit & applied) = 0)) as l from walk) w join {{cells}} c on c.part = w.part
            )
        )
        select part, prefix as filter_order, inline(trail) from walk where length(prefix) = {n} limit all
        """,
        cells=cells,
    )


def audit(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Column] | None = None, repeat_letter: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    rules maps a letter to a failure condition over a document's row; repeat_letter is one more filter, which fails texts that
    a smaller id has too, or None.  Null texts count as empty, a null part as the empty text.  Null ids and equal ids are never
    smaller: repeated rows of the least id pass.  Labels that repeat an id count once, as 1 if any is.  Long texts are read
    whole.  Other columns of docs are not read.  A table without rows has no parts and so no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rules = text_rules(text) if rules is None else rules
    letters = "".join(rules) + (repeat_letter or "")
    cells = settle(cells_of(masked(docs, rules, repeat_letter, id_col, text_col, part_col), labels, id_col, len(letters)))
    steps = settle(orders(cells, letters))
    shapley = steps.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return steps.join(shapley.hint("merge"), ["part", "letter"]).select("part", "filter_order", "step", *METRICS, "shapley")


def number_of_rows(n_filters: int) -> int:
    """Rows of the audit per part."""
    return factorial(n_filters) * n_filters


def op12_filter_interaction_audit(spark, sf_dir):
    from docloom.llm.shared import read

    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLE = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as least from t),
f as (select doc_id, part,
    (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int
    + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(doc_id > least, false)::int as mask from w),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
cells as (select part, mask, count(*) as docs, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by all),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
five as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order from letters a, letters b, letters c, letters d, letters e where (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps as (select filter_order, step::int as step, bit, letter, coalesce((select sum(p.bit) from letters p where instr(filter_order, p.letter) < step), 0)::int as applied
    from five, range(1, 6) r(step), letters where letter = filter_order[step]),
m as (select part, filter_order, step, letter,
    coalesce(sum(docs) filter (mask & (applied | bit) = 0), 0)::bigint as kept,
    coalesce(sum(docs) filter (mask & applied = 0 and mask & bit <> 0), 0)::bigint as removed,
    coalesce(sum(docs) filter (mask & applied <> 0 and mask & bit <> 0), 0)::bigint as redundant,
    coalesce(sum(docs) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & applied = 0 and mask & bit <> 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mask & applied = 0 and mask & bit <> 0), 0)::bigint as toxic_lost
    from steps, cells group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from m
"""
