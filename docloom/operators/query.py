"""Reading queries: time phrases, key words, and filters on result lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import SEPARATORS, S, collapse
from docloom.lexicon import EXTENSIONS, PARTICLES, STOPWORDS, TIME_PHRASES


def temporal_intent(query: Column) -> tuple[Column, Column]:
    """(half-life in days or null, query without its time phrases).  The shortest half-life wins."""
    rest, lives = query, []
    for phrase, days in TIME_PHRASES:
        lives.append(F.when(F.contains(rest, F.lit(phrase)), F.lit(days)))
        rest = F.replace(rest, F.lit(phrase), F.lit(" "))
    return F.least(*lives), collapse(rest)


def _stripped(token: Column) -> Column:
    """Without its first matching particle, if two characters remain."""
    rules = [((F.endswith(token, F.lit(p))) & (F.length(token) - len(p) >= 2), len(p)) for p in PARTICLES]
    size = reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(0))
    return F.substring(token, F.lit(1), F.length(token) - size)


def query_tokens(cleaned: Column) -> Column:
    """Key words of a query without time phrases, each once, in order."""
    stop = F.array(*map(F.lit, STOPWORDS))
    words = F.filter(F.split(F.lower(F.regexp_replace(cleaned, SEPARATORS, " ")), rf"{S}+"), lambda x: (x != "") & ~F.array_contains(stop, x))
    words = F.transform(words, _stripped)
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) >= 2) & ~F.array_contains(stop, x)))


def parse_queries(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """queries with tokens, half_life and cleaned."""
    half_life, cleaned = temporal_intent(F.col(query_col))
    return queries.withColumns({"half_life": half_life, "cleaned": cleaned}).withColumn("tokens", query_tokens(F.col("cleaned")))


def result_filters(results: DataFrame, types: list[str], targets: list[str], term: str, date_from: str = "", date_to: str = "", newest_first: bool = False) -> DataFrame:
    """Filter a result list (title, type, path, date, snippet) as a result page does.

    Unknown types pass.  A row without a date fails any date limit.  With one or two of title, content and path
    chosen, one of them must hold a word of the term; with none chosen nothing passes.
    """
    words = [w for w in term.lower().split() if len(w) > 1]
    known = [e.upper() for e in EXTENSIONS]
    ok = F.col("type").isin(types) | ~F.col("type").isin(known)
    for limit, holds in ((date_from, F.col("date") >= date_from), (date_to, F.col("date") <= date_to)):
        if limit:
            ok &= (F.coalesce(F.col("date"), F.lit("")) != "") & holds
    if not targets:
        ok &= F.lit(False)
    elif len(targets) < 3 and words:
        texts = {"title": F.col("title"), "content": F.col("snippet"), "path": F.concat_ws(" ", "path", "date")}
        ok &= F.exists(F.array(*(F.lower(texts[t]) for t in targets)), lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w)))
    out = results.where(ok)
    return out.orderBy(F.desc("date"), "title") if newest_first else out


def keyword_filter(items: DataFrame, q: str = "", year: str | None = None, sort: str = "score") -> DataFrame:
    """Rows (name, path, snippet, modified, score) that hold q, of a year, sorted by score, recent or name."""
    needle = q.lower().strip()
    if needle:
        items = items.where(F.exists(F.array("name", "path", "snippet"), lambda x: F.contains(F.lower(x), F.lit(needle))))
    if year:
        items = items.where(F.startswith("modified", F.lit(year)))
    order = {"recent": F.desc("modified"), "name": F.asc("name")}.get(sort, F.desc("score"))
    return items.orderBy(order, "name", "path")


def active_source(user: DataFrame, dataset: DataFrame) -> DataFrame:
    """The user's collection if it has rows, else the data set."""
    has = user.limit(1).agg(F.count("*").alias("__n"))
    fallback = dataset.join(F.broadcast(has), F.col("__n") == 0).drop("__n")  # one row decides: a join with a single count
    return user.unionByName(fallback)


def usable_only(rows: DataFrame, error_col: str = "error", text_col: str = "normalized_text") -> DataFrame:
    return rows.where((F.coalesce(F.col(error_col), F.lit("")) == "") & (F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0))


def success_only(rows: DataFrame, status_col: str = "extraction_status") -> DataFrame:
    return rows.where(F.col(status_col) == "success")
