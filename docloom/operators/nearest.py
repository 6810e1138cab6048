"""Exact nearest vectors by dot product, in matrix products over blocks.

Which side moves depends on counted sizes: few points go to every task, few queries go to every task, and where both are many,
the points are dealt into cells around sampled pivots.  A cell knows its largest angle from the pivot and its least and largest
length, so by the triangle inequality no point of it can be nearer than a bound.  A query first visits the cells that
promise most, which gives the score that others must reach, and then only the cells whose bound reaches it.  What meets in
one task is a block of a cell's points and a slice of its queries, both of a fixed size however the table is partitioned.
If a few queries show that most cells have to be visited, as with vectors that lie evenly in many dimensions, queries and points meet
block by block instead, so that a query moves once for each block of points and not for each cell.
Inside a task rows are worked on in pieces, so what it holds beside its block and slice is some ten MB however many pairs or cells
there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import settle

#: Points that are sent to every task at most, and rows of a block or slice; queries that are sent at most; pivots at most.
BLOCK, FEW_QUERIES, MOST_PIVOTS = 20_000, 2_000, 256
#: Queries that tell whether cells can be left out, and the part of the cells that may be visited for that to pay.
TRIED, MOST_VISITED = 64, 0.25
#: Rows that are looked at in one go beside so many columns: a matrix of 16 MB.
ROWS, COLUMNS = 512, 4096
#: Scores are told apart to this many digits; below it, ids decide.
DIGITS = 12
EMPTY = pd.DataFrame({"id": [], "eid": [], "sim": []})


def best_of(ids: np.ndarray, x: np.ndarray, eids: np.ndarray, y: np.ndarray, n: int, topics: tuple[np.ndarray, np.ndarray] | None = None, floor: np.ndarray | None = None) -> pd.DataFrame:
    """(id, eid, sim): the n best of y for each row of x, ties by example id; eids ascend.  Pairs of one topic do not count, nor what is below a row's floor."""
    out = [pd.DataFrame({"id": ids[:0], "eid": eids[:0], "sim": np.zeros(0)})]
    for at in range(0, len(x) if len(y) else 0, ROWS):
        part = x[at : at + ROWS]
        least = np.full(len(part), -np.inf) if floor is None else floor[at : at + ROWS].copy()
        row, col, sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for left in range(0, len(y), COLUMNS):
            sims = part @ y[left : left + COLUMNS].T
            if topics is not None:
                sims[topics[0][at : at + ROWS, None] == topics[1][None, left : left + COLUMNS]] = -np.inf
            cut = least
            if sims.shape[1] > n and np.isneginf(least).any():  # sort only what can be among the best
                cut = np.maximum(least, np.partition(sims, sims.shape[1] - n, axis=1)[:, sims.shape[1] - n])
            reach = np.where(np.isfinite(cut), cut - 2 * 10.0**-DIGITS - 1e-15 * np.abs(cut), -np.inf)  # sims are not rounded yet
            r, c = np.nonzero((sims >= reach[:, None]) & np.isfinite(sims))
            s = np.round(sims[r, c], DIGITS)
            enough = s >= least[r]
            row, col, sim = np.concatenate((row, r[enough])), np.concatenate((col, c[enough] + left)), np.concatenate((sim, s[enough]))
            order = np.lexsort((col, -sim, row))
            row, col, sim = row[order], col[order], sim[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, sim, place = (z[place < n] for z in (row, col, sim, place))
            least[row[place == n - 1]] = sim[place == n - 1]
        out.append(pd.DataFrame({"id": ids[at + row], "eid": eids[col], "sim": sim}))
    return pd.concat(out)


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 0))


def compared(a: pd.DataFrame, b: pd.DataFrame, n: int) -> pd.DataFrame:
    """a(id, v[, topic, floor]) with the n best of b(eid, ev[, topic]) from the floor on; pairs of one topic do not count."""
    if not len(a) or not len(b):
        return EMPTY
    b = b.sort_values("eid")
    topics = (a["topic"].to_numpy(), b["topic"].to_numpy()) if "topic" in a else None
    floor = a["floor"].fillna(-np.inf).to_numpy(np.float64) if "floor" in a else None
    return best_of(a["id"].to_numpy(), matrix(a["v"]), b["eid"].to_numpy(), matrix(b["ev"]), n, topics, floor)


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut into pieces of ROWS rows."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.iloc[at : at + ROWS]


def first(met: DataFrame, n: int) -> DataFrame:
    """The n best of each id with their place from 1 on."""
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "eid"))
    return met.withColumn("place", place).where(F.col("place") <= n)


def scored_kind(docs: DataFrame, points: DataFrame) -> str:
    return f"id {docs.schema['id'].dataType.simpleString()}, eid {points.schema['eid'].dataType.simpleString()}, sim double"


def with_few_points(docs: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """Points go to every task; docs do not move."""
    held = docs.sparkSession.sparkContext.broadcast(points.toPandas())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield compared(batch, held.value, n)

    return docs.mapInPandas(run, scored_kind(docs, points))


def with_few_queries(docs: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """Docs, the queries, go to every task, and points do not move; a task hands on its n best of each query."""
    held = docs.sparkSession.sparkContext.broadcast(docs.toPandas())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = EMPTY
        for batch in batches:
            both = pd.concat([x for x in (best, compared(held.value, batch, n)) if len(x)] or [EMPTY])
            best = both.sort_values(["id", "sim", "eid"], ascending=[True, False, True]).groupby("id", sort=False).head(n)
        yield best

    return points.mapInPandas(run, scored_kind(docs, points))


def without_surplus_copies(points: DataFrame, n: int) -> DataFrame:
    """Of equal vectors (and topics) only the n least ids can be among any n best.  Hot vectors are thinned in parts first."""
    same = ["ev", *(["topic"] if "topic" in points.columns else [])]
    part = F.pmod(F.xxhash64("eid"), F.lit(64))
    thin = points.withColumn("__p", part)
    for keys in ([*same, "__p"], same):
        thin = thin.withColumn("__r", F.row_number().over(Window.partitionBy(F.xxhash64("ev"), *keys).orderBy("eid"))).where(F.col("__r") <= n).drop("__r")
    return thin.drop("__p")


class Cells:
    """Points dealt into cells, ready for queries of the n best."""

    def __init__(self, points: DataFrame, n: int, block: int = BLOCK, most_pivots: int = MOST_PIVOTS):
        self.n, self.block = n, block
        points = settle(without_surplus_copies(points, n))
        p = max(1, min(most_pivots, math.isqrt(points.count())))
        sample = points.select("ev", F.xxhash64("eid").alias("h")).orderBy("h").limit(p).collect()
        pivots = np.array([r["ev"] for r in sample], np.float64) if sample else np.ones((1, 1))
        length = np.linalg.norm(pivots, axis=1)
        pivots = np.unique(pivots[length > 0] / length[length > 0, None], axis=0) if (length > 0).any() else np.eye(1, pivots.shape[1])
        self.pivots = pivots

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in pieces(batches):
                angle, length = angles(matrix(batch["ev"]), pivots)
                cell = angle.argmin(axis=1)
                yield batch.assign(cell=cell, angle=angle[np.arange(len(cell)), cell], length=length)

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", cell long, angle double, length double"
        self.placed = settle(points.mapInPandas(place, kinds))
        self.count = np.zeros(len(pivots), np.int64)
        self.widest, self.least, self.largest = (np.zeros(len(pivots)) for _ in range(3))
        for r in self.placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("a"), F.min("length").alias("lo"), F.max("length").alias("hi")).collect():
            self.count[r["cell"]], self.widest[r["cell"]], self.least[r["cell"]], self.largest[r["cell"]] = r["n"], r["a"], r["lo"], r["hi"]

    def visits(self, docs: DataFrame) -> DataFrame:
        """docs with floor and a row per cell to visit: without a floor the cells that promise most, enough of them to hold
        twice n points; with one all others that can reach it."""
        count, widest, least, largest, pivots, n = self.count, self.widest, self.least, self.largest, self.pivots, self.n

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in pieces(batches) if count.any() else ():
                angle, length = angles(matrix(batch["v"]), pivots)
                near = np.cos(np.maximum(0.0, angle - widest))
                bound = length[:, None] * np.where(near > 0, largest * near, least * near)
                bound = np.where(count > 0, bound + 1e-9 * (1 + length[:, None] * largest), -np.inf)
                order = np.argsort(-bound, axis=1, kind="stable")
                held = np.cumsum(count[order], axis=1)
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, order, held - count[order] < 2 * n, axis=1)
                early &= count > 0
                floor = batch["floor"].to_numpy(np.float64)
                wanted = np.where(np.isnan(floor)[:, None], early, ~early & (bound >= np.nan_to_num(floor, nan=0.0)[:, None]))
                row, cell = np.nonzero(wanted)
                for at in range(0, len(row), COLUMNS):  # a query may visit every cell
                    yield batch.iloc[row[at : at + COLUMNS]].assign(cell=cell[at : at + COLUMNS])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", cell long"
        return docs.mapInPandas(run, kinds)

    def dealt(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Queries and points with cell, block and slice: what meets in one task is at most about a block of either side."""
        spark, asked = asked.sparkSession, settle(asked)
        many = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
        size = lambda rows: max(1, math.ceil(rows / (0.8 * self.block)))  # noqa: E731  parts are dealt by hash, so not quite alike
        meta = spark.createDataFrame([(c, size(int(self.count[c])), size(k)) for c, k in many.items()], "cell long, blocks int, slices int")
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = asked.join(F.broadcast(meta), "cell").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")).withColumn("block", upto("blocks"))
        right = self.placed.join(F.broadcast(meta), "cell").withColumn("block", F.pmod(F.xxhash64("eid", F.lit(1)), F.col("blocks")).cast("int")).withColumn("slice", upto("slices"))
        keys, topic = ["cell", "block", "slice"], ["topic"] if "topic" in asked.columns else []
        return left.select(*keys, "id", "v", "floor", *topic), right.select(*keys, "eid", "ev", *topic)

    def visit(self, asked: DataFrame) -> DataFrame:
        """(id, eid, sim) of queries beside the cells they visit: each block keeps its n best of a query."""
        left, right = self.dealt(asked)
        n, keys, kind = self.n, ["cell", "block", "slice"], scored_kind(asked, self.placed)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: compared(a, b, n), kind)

    def pays(self, docs: DataFrame) -> bool:
        """Do a few queries, whose n best are known, visit so few cells that these are worth their rows?"""
        few = docs.orderBy(F.xxhash64("id")).limit(TRIED)
        best = with_few_queries(few, self.placed.select("eid", "ev", *(["topic"] if "topic" in docs.columns else [])), self.n)
        floor = first(best, self.n).groupBy("id").agg(F.when(F.count("*") >= self.n, F.min("sim")).alias("floor"))
        tried = settle(few.join(floor.hint("merge"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf))))
        visited = self.visits(tried).count() + self.visits(tried.withColumn("floor", F.lit(None).cast("double"))).count()
        return visited <= MOST_VISITED * tried.count() * np.count_nonzero(self.count)

    def nearest(self, docs: DataFrame) -> DataFrame:
        """docs(id, v[, topic]) to (id, eid, sim, place)."""
        early = settle(first(self.visit(self.visits(docs.withColumn("floor", F.lit(None).cast("double")))), self.n).drop("place"))
        floor = early.groupBy("id").agg(F.when(F.count("*") >= self.n, F.min("sim")).alias("floor"))
        again = docs.join(floor.hint("merge"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(-math.inf)))
        late = self.visit(self.visits(again.select(*docs.columns, "floor")))
        return first(early.unionByName(late), self.n)


def by_blocks(docs: DataFrame, points: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Every slice of docs meets every block of points in a task of its own; blocks grow up to four times, once there are tasks enough."""
    many, of = docs.count(), points.count()
    size = 0.8 * min(4 * block, max(block, math.isqrt(many * of // 64)))  # dealt by hash, so not quite alike
    slices, blocks = max(1, math.ceil(many / size)), max(1, math.ceil(of / size))
    upto = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = docs.withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")).withColumn("block", upto(blocks))
    right = points.withColumn("block", F.pmod(F.xxhash64("eid", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("slice", upto(slices))
    keys = ["block", "slice"]
    return first(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: compared(a, b, n), scored_kind(docs, points)), n)


def angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angle of each row to each pivot and its length; a row without length is at no angle to any."""
    length = np.linalg.norm(x, axis=1)
    unit = x / np.where(length > 0, length, 1.0)[:, None]
    return np.where(length[:, None] > 0, np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0)), 0.0), length


def nearest(docs: DataFrame, points: DataFrame, n: int, block: int = BLOCK, few_queries: int = FEW_QUERIES) -> DataFrame:
    """docs(id, v[, topic]), points(eid, ev[, topic]) to (id, eid, sim, place): the n nearest points by dot product, exactly.

    Ties go to the smaller eid.  With topics, points of the query's own topic do not count.  Vectors have one length and no
    nulls; they need not be unit vectors, and null vectors are no rows of either side.  ids are those of one row each.
    """
    topic = ["topic"] if "topic" in docs.columns else []
    docs, points = docs.select("id", "v", *topic).where("v is not null"), points.select("eid", "ev", *topic).where("ev is not null")
    if points.limit(block + 1).count() <= block:
        return first(with_few_points(docs, points, n), n)
    if docs.limit(few_queries + 1).count() <= few_queries:
        return first(with_few_queries(docs, points, n), n)
    cells = Cells(points, n, block)
    return cells.nearest(docs) if cells.pays(docs) else by_blocks(docs, cells.placed.select(points.columns), n, block)


def clamped(sim: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sim))
