"""Queries beside their SQL on tables that the given small ones do not look like: full lists of names, and ties."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from docloom.registry import ORACLES, QUERIES
from tests.test_oracles import plain


def same(spark, sf_dir, name, tables):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    order = [d[0] for d in found.description]
    theirs = Counter(tuple(plain(r[order.index(c)]) for c in columns) for r in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == theirs
    return theirs


@pytest.fixture(scope="module")
def full_lists(spark, tmp_path_factory):
    """More moves to one name than there are numbers."""
    place = str(tmp_path_factory.mktemp("lists"))
    spark.range(16_000).selectExpr("id * 7 as doc_id", "'x' as text", "'en' as lang", "'src1' as source", "1 as n_chars").write.parquet(f"{place}/documents.parquet")
    return place


@pytest.mark.parametrize("name", ["h2_assign_targets", "h2_window_targets", "h3_plan_summary", "h4_record_history", "h10_catalog_after_apply", "h10_pending_after_apply"])
def test_moves_beyond_the_last_number(spark, full_lists, name):
    found = same(spark, full_lists, name, ["documents"])
    if name == "h2_assign_targets":
        assert any("conflict_exhausted" in r for r in found)


def test_equal_scores_go_by_path(spark):
    """Sums that differ in their last digits only are ties: the words weigh the same, but are summed in another order."""
    from pyspark.sql import functions as F

    from docloom.operators import retrieve as rt

    words = [f"w{k:02d}" for k in range(20)]
    bodies = [" ".join(words[k:] + words[:k]) for k in range(12)]
    docs = spark.createDataFrame([(k, f"/p{k:02d}.pdf", f"p{k:02d}.pdf", b) for k, b in enumerate(bodies)], "id long, path string, name string, body string").withColumn("modified_at", F.to_timestamp(F.lit("2024-01-01")))
    queries = spark.createDataFrame([(1, " ".join(words), words, None)], "query_id long, query string, tokens array<string>, half_life double")
    apart = F.when(F.col("id") % 2 == 0, 1e-13).otherwise(0.0)
    held = rt.keyword_scores
    rt.keyword_scores = lambda *a, **k: held(*a, **k).withColumn("keyword", F.col("keyword") - apart)
    try:
        out = rt.hybrid_search(queries, docs, F.to_timestamp(F.lit("2024-03-01"))).collect()
    finally:
        rt.keyword_scores = held
    assert [r["id"] for r in sorted(out, key=lambda r: r["rank"])] == list(range(12))
