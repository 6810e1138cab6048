"""Pairs of a query and a document are formed, summed and ranked in the task that holds the document."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from docloom.operators import postings
from docloom.operators import retrieve as rt
from docloom.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d3_keyword_score", "d7_candidate_union", "d8_first_gate"])
def test_pairs_are_not_dealt_again(spark, sf, name):
    out = plan(QUERIES[name](spark, sf))
    assert not re.search(r"Exchange hashpartitioning\([^)]*query_id#\d+L, id#", out) and "SortMergeJoin" not in out


@pytest.mark.parametrize("name", ["d_keyword_search", "d11_best_row_of_a_path", "d13_hybrid_search"])
def test_only_first_rows_are_dealt_by_query(spark, sf, name):
    """Below each exchange by query there is a limit a query, or there are no pairs yet."""
    out = plan(QUERIES[name](spark, sf))
    first = max(m.start() for m in re.finditer(r"Exchange hashpartitioning\(query_id", out) if "posexplode" not in out[m.start() :] and "explode(codes" in out[m.start() :])
    assert re.match(r"[^\n]*\n[^\n]*WindowGroupLimit [^\n]*Partial", out[first:])


def pages(spark, n=400):
    """Files of up to four rows, ties among them, and words in some bodies only."""
    rows = [(k, f"/f{k * 7 % n // 4:03d}.pdf", f"n{k}.pdf", " ".join(w for j, w in enumerate(("alpha", "beta", "gamma", "delta")) if (k >> j) % 2)) for k in range(n)]
    return spark.createDataFrame(rows, "id long, path string, name string, body string").withColumn("modified_at", F.to_timestamp(F.lit("2024-01-01")))


def test_first_rows_give_the_same_ranks(spark, monkeypatch):
    docs = pages(spark)
    words = [["alpha", "beta"], ["delta"], ["absent"], ["gamma", "alpha", "delta"]]
    queries = spark.createDataFrame([(q, " ".join(w), w, None) for q, w in enumerate(words)], "query_id long, query string, tokens array<string>, half_life double")
    unit = F.array(F.cos(F.col("id") * 0.37), F.sin(F.col("id") * 0.37))
    vectors, asked = docs.select("id", unit.alias("v")), queries.select("query_id", F.array(F.cos("query_id"), F.sin("query_id")).alias("qv"))
    search = lambda: [tuple(r) for r in rt.hybrid_search(queries, docs, F.to_timestamp(F.lit("2024-03-01")), asked, vectors, top_k=5).orderBy("query_id", "rank").collect()]
    cut = search()
    monkeypatch.setattr(rt, "MOST_RANKED", 0)
    assert cut == search() and len(cut) == 20


def test_one_pass_cuts_texts_anywhere(spark):
    """Blanks that only Unicode knows, letters beyond the first plane, and tokens of every length."""
    rows = [(1, "A b.txt", "x yz abcd😀efgh abcdefgh abcdefgh", 0), (2, "q.txt", "😀😀 école ABCDE-abc", 0), (3, "", None, 0)]
    tokens = ["a", "ab", "abc", "abcd", "abcde", "bcdefg", "😀", "d😀ef", "😀😀", "yz", "école", "éco", "qtxt", "abtxt", "absent"]
    docs = spark.createDataFrame([(*r[:3], "w", "g", "t") for r in rows], "id long, name string, body string, word string, gram string, token string")
    found = [tuple(r) for r in postings.scanned(spark.createDataFrame([(t,) for t in tokens], "token string"), docs).collect()]
    flat = {k: re.sub(r"[-_.()\[\]{}·,~]|\s", "", n).lower() for k, n, *_ in rows}
    assert sorted(found) == sorted((t, k, t in flat[k]) for k, _, b, _ in rows for t in tokens if t in flat[k] or t in (b or "").lower())


def test_common_words_change_nothing(spark, monkeypatch):
    """Words whose tokens are told once, from the first documents, and words that are cut into runs give the same."""
    docs = spark.createDataFrame([(k, f"n{k}.txt", f"every rare{k} wordly {'tail' * (k % 3)}") for k in range(40)], "id long, name string, body string")
    tokens = spark.createDataFrame([(t,) for t in ("ever", "very", "rd", "rare7", "talta", "iltail", "ly", "n3", "every")], "token string")
    found = lambda: sorted(tuple(r) for r in postings.scanned(tokens, docs, 10).collect())
    known = found()
    monkeypatch.setattr(postings, "MOST_COMMON", 0)
    assert known == found() and len(known) > 200
