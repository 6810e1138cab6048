"""Nearest vectors on all three paths against brute force; what the cells skip and how they are dealt."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import nearest as nr


def brute(docs, points, n, topics=False):
    out = set()
    for i, v, *t in docs:
        near = [(-round(float(np.dot(v, w)), 12), e) for e, w, *u in points if not topics or t != u]
        out |= {(i, e, round(-s, 9), k) for k, (s, e) in enumerate(sorted(near)[:n], 1)}
    return out


def rows(df):
    return {(r["id"], r["eid"], round(r["sim"], 9), r["place"]) for r in df.collect()}


def clustered(n, groups, size, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    x = centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def data(spark):
    x = clustered(240, 8, 6, 0.3, 1)
    x[100:160] = x[100]  # many copies
    x[200] = 0  # no direction
    x[201] *= 3  # not a unit vector
    x = np.round(x, 6)
    points = [(k, v.tolist(), k % 3) for k, v in enumerate(x)]
    docs = [(1000 + k, v.tolist(), k % 3) for k, v in enumerate(x[::6])] + [(2000, [0.0] * 6, 0), (2001, (-x[3]).tolist(), 1)]
    return docs, points, spark.createDataFrame(docs, "id long, v array<double>, topic long"), spark.createDataFrame(points, "eid long, ev array<double>, topic long")


@pytest.mark.parametrize("n", [1, 7, 300])
@pytest.mark.parametrize("topics", [False, True])
def test_three_paths_are_exact(data, n, topics):
    docs, points, d, p = data
    d, p = (d, p) if topics else (d.drop("topic"), p.drop("topic"))
    wanted = brute(docs, points, n, topics)
    assert rows(nr.nearest(d, p, n)) == wanted
    assert rows(nr.nearest(d, p, n, block=20)) == wanted
    assert rows(nr.nearest(d, p, n, block=20, few_queries=0)) == wanted


def test_cells_skip_most_pairs(spark):
    x = clustered(6000, 60, 16, 0.08, 2)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "eid long, ev array<double>")
    docs = points.selectExpr("eid as id", "ev as v").where("id % 3 = 0")
    cells = nr.Cells(points, 5)
    early = cells.visits(docs.withColumn("floor", F.lit(None).cast("double")))
    best = nr.first(cells.visit(early), 5)
    floors = docs.join(best.groupBy("id").agg(F.min("sim").alias("floor")), "id")
    late = cells.visits(floors)
    met = sum(int(cells.count[r["cell"]]) * r["count"] for v in (early, late) for r in v.groupBy("cell").count().collect())
    share = 1 - met / (2000 * 6000)
    print(f"share of pairs skipped: {share:.3f}")
    assert share > 0.8


@pytest.mark.parametrize("parts", [1, 64])
def test_no_task_meets_more_than_a_block(spark, parts):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        x = clustered(3000, 3, 4, 0.05, 3)
        points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "eid long, ev array<double>")
        cells = nr.Cells(points, 5, block=400, most_pivots=4)
        for side in cells.dealt(cells.visits(points.selectExpr("eid as id", "ev as v", "cast(null as double) as floor"))):
            assert max(r["count"] for r in side.groupBy("cell", "block", "slice").count().collect()) <= 400
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_copies_are_thinned_before_they_meet(spark):
    points = spark.range(5000).selectExpr("id as eid", "array(1.0D, 2.0D) as ev")
    assert sorted(r["eid"] for r in nr.without_surplus_copies(points, 4).collect()) == [0, 1, 2, 3]


def test_nothing_on_a_side(data):
    _, _, d, p = data
    for block in (nr.BLOCK, 20):
        assert nr.nearest(d.where("false"), p, 3, block, 0).count() == 0
    assert nr.nearest(d, p.where("false"), 3).count() == 0
    assert nr.Cells(p.where("false"), 3).nearest(d).count() == 0


def test_pieces_of_a_task_stay_small(spark, monkeypatch):
    """However many pairs and cells there are, no matrix and no batch that a task hands on is larger than a piece."""
    largest = []
    held = np.nonzero

    def seen(a):
        largest.append(a.size)
        return held(a)

    monkeypatch.setattr(nr.np, "nonzero", seen)
    x = clustered(9000, 20, 8, 0.3, 5)
    topic = np.arange(9000) % 3
    got = nr.best_of(np.arange(9000), x, np.arange(9000), x, 5, (topic, topic))
    monkeypatch.undo()
    assert max(largest) <= nr.ROWS * nr.COLUMNS
    for i in (0, 17, 8999):
        sims = np.where(topic == topic[i], -np.inf, np.round(x @ x[i], nr.DIGITS))
        assert got[got["id"] == i]["eid"].tolist() == sorted(range(9000), key=lambda e: (-sims[e], e))[:5]
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x[:2000])], "eid long, ev array<double>").coalesce(1)
    docs = points.selectExpr("eid as id", "ev as v", "double('-infinity') as floor")
    sizes = nr.Cells(points, 5).visits(docs).select(F.spark_partition_id().alias("p"))
    assert sizes.count() > 2000 * 30  # all cells, handed on in pieces


def test_blocks_where_cells_do_not_pay(spark):
    even = np.random.default_rng(6).normal(size=(1500, 32))  # no cell can be left out
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(even)], "eid long, ev array<double>")
    docs = points.selectExpr("eid as id", "ev as v").where("id % 5 = 0")
    assert not nr.Cells(points, 5, 300).pays(docs)
    wanted = brute([(k, v) for k, v in enumerate(even) if k % 5 == 0], list(enumerate(even)), 5)
    assert rows(nr.nearest(docs, points, 5, 300, 100)) == wanted
    x = clustered(3000, 60, 16, 0.05, 2)
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "eid long, ev array<double>")
    assert nr.Cells(points, 5, 300).pays(points.selectExpr("eid as id", "ev as v"))


def test_floors_leave_the_best(data):
    docs, points, _, _ = data
    x, y = np.array([v for _, v, _ in docs]), np.array([v for _, v, _ in points])
    ids, eids = np.array([i for i, _, _ in docs]), np.array([e for e, _, _ in points])
    every = nr.best_of(ids, x, eids, y, 7)
    floor = every.groupby("id", sort=False)["sim"].min().reindex(ids).to_numpy()
    assert nr.best_of(ids, x, eids, y, 7, None, floor).equals(every)
