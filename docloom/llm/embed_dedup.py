"""Embedding near-duplicates by sorted projection passes.

Each pass gives a vector a key: the bits of its sides of random hyperplanes, put one after the other.  Sorting by that key
brings similar vectors close together, and each vector is compared with the next few in the order.  Pairs that reach the
cosine, computed in doubles, are joined over all passes.  The number of passes follows from the number of vectors and the
wanted recall of a lone pair at the cosine; then passes with new hyperplanes are added until a round of them joins no
two components any more.

A bounded window sees only some of the pairs inside a large group, so counts are completed exactly inside each component:
vectors within half the allowed angle of the component's first vector are all linked with one another, by the triangle
inequality for angles, and are counted without any comparison; the rest is compared with its component in blocks.
Equal vectors are one class from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import HUBS, by_key, components, settle

PASSES, WINDOW, BITS, COSINE, BLOCK = 24, 24, 48, 0.9, 1024
#: A lone pair at the cosine is to be met with this probability by the first passes; PASSES is the least number of them.
RECALL = 0.999


def passes_for(rows: int, window: int = WINDOW, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Passes that bring a lone pair at the cosine within the window with probability recall.

    A sign bit agrees with probability 1 - angle / pi.  About log2(rows / window) leading bits leave a window of vectors
    if they are uniform; one bit more allows for places where they are denser.
    """
    bits = max(0, math.ceil(math.log2(max(1.0, rows / window)))) + 1
    met = min(1 - 1e-12, (1 - math.acos(cosine) / math.pi) ** bits)
    return max(PASSES, math.ceil(math.log(1 - recall) / math.log1p(-met)))


def unit_rows(vectors) -> np.ndarray:
    x = vectors.astype(np.float64) if isinstance(vectors, np.ndarray) and vectors.ndim == 2 else np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector) -> F.Column:
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(ok & F.exists(vector, lambda x: x != 0), F.lit(False))


def keyed(classes: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """(pass, key, id, v) rows: the classes once a pass."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 2000):
                part = lists.slice(at, 2000)
                for size, rows, x in by_size(vectors_of(part)):
                    if size not in planes:
                        planes[size] = np.random.default_rng(seed + size).standard_normal((passes * bits, size))
                    sides = np.packbits((unit_rows(x) @ planes[size].T > 0).reshape(len(rows), passes, bits), axis=2)
                    key = sum(sides[:, :, k].astype(np.int64) << (8 * (sides.shape[2] - 1 - k)) for k in range(sides.shape[2]))
                    index = pa.array(at + rows)
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), p, np.int32)), pa.array(key[:, p]), ids.take(index), lists.take(index)], ["pass", "key", "id", "v"])

    return classes.select("id", "v").mapInArrow(run, f"pass int, key long, id long, v {classes.schema['v'].dataType.simpleString()}")


def vectors_of(lists: pa.ListArray):
    """Vectors as the rows of a matrix if they are of one length, else as a list."""
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes = np.diff(ends)
    if len(sizes) and (sizes == sizes[0]).all():
        return values.reshape(len(sizes), sizes[0])
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def put_after(held, x):
    """The vectors held and then those of x."""
    if isinstance(held, np.ndarray) and isinstance(x, np.ndarray) and held.shape[1] == x.shape[1]:
        return np.concatenate([held, x])
    return [*held, *x]


def by_size(vectors) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, vectors) of the vectors of each length."""
    if isinstance(vectors, np.ndarray):
        return [(vectors.shape[1], np.arange(len(vectors)), vectors)]
    sizes: dict[int, list] = {}
    for k, v in enumerate(vectors):
        sizes.setdefault(len(v), []).append(k)
    return [(n, np.array(at), np.stack([vectors[k] for k in at])) for n, at in sizes.items()]


def pairs_within(ids: np.ndarray, passes: np.ndarray, x: list, window: int, cosine: float, first: int = 0):
    """Verified pairs of rows at most window apart and of one pass; both ends not before first for the later row."""
    sizes = np.array([len(v) for v in x])
    unit = unit_rows(x) if isinstance(x, np.ndarray) or len(set(sizes.tolist())) == 1 else None
    found = []
    for step in range(1, min(window, len(x) - 1) + 1):
        if unit is not None:
            hit = (np.einsum("ij,ij->i", unit[:-step], unit[step:]) >= cosine) & (passes[:-step] == passes[step:])
        else:
            hit = np.array([passes[k] == passes[k + step] and sizes[k] == sizes[k + step] and float((unit_rows([x[k]]) * unit_rows([x[k + step]])).sum()) >= cosine for k in range(len(x) - step)])
        at = np.flatnonzero(hit)
        at = at[at + step >= first]
        found.append(np.stack([ids[at], ids[at + step]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (least id, id) that connect just what the given pairs connect: one fewer than there are ids in each group."""
    ids, at = np.unique(pairs, return_inverse=True)
    at, label = at.reshape(pairs.shape), np.arange(len(ids))
    while True:
        low = label[at].min(axis=1)
        new = label.copy()
        np.minimum.at(new, at[:, 0], low)
        np.minimum.at(new, at[:, 1], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return np.stack([ids[label[moved]], ids[moved]], axis=1)


def candidate_pairs(classes: DataFrame, passes: int, window: int, bits: int, cosine: float, seed: int) -> DataFrame:
    """Pairs (a, b) of class ids that connect all that some pass brought within the window and that reach the cosine.

    A task hands on a spanning forest of the pairs it has verified, so a large group costs a row a vector and pass.
    """
    parts = max(passes, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    vectors = classes.schema["v"].dataType.simpleString()
    ordered = keyed(classes, passes, bits, seed).repartitionByRange(parts, "pass", "key", "id").sortWithinPartitions("pass", "key", "id")

    def run(batches):
        place, held, started = TaskContext.get().partitionId(), None, False
        names = ["a", "b", "border", "pass", "v"]

        def edges(pairs):
            n = len(pairs)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, kind)], names)

        def border(rows, at, base):
            n = len(rows[0])
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(np.arange(base, base + n), pa.int64()), pa.array([at] * n, pa.int32()), pa.array(rows[1], pa.int32()), pa.array(list(rows[2]), kind)], names)

        kind = pa.list_(pa.float32() if vectors == "array<float>" else pa.float64())
        for batch in batches:
            ids, p = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False)
            x = vectors_of(batch.column(3))
            if not len(ids):
                continue
            first = 0
            if held is not None:
                first = len(held[0])
                ids, p, x = np.concatenate([held[0], ids]), np.concatenate([held[1], p]), put_after(held[2], x)
            elif place:
                yield border((ids[:window], p[:window], x[:window]), place - 1, window)  # after the end of the part before
            for at in range(0, len(ids), 2000):
                lo, hi = max(0, at - window), min(len(ids), at + 2000)
                if hi > first:
                    yield edges(forest(pairs_within(ids[lo:hi], p[lo:hi], x[lo:hi], window, cosine, max(at, first) - lo)))
            held = ids[-window:], p[-window:], x[-window:]
        if held is not None:
            yield border(held, place, window - len(held[0]))

    out = settle(ordered.mapInArrow(run, f"a long, b long, border int, pass int, v {vectors}"))

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("b")
        split = int((rows["b"] < window).sum())
        found = pairs_within(rows["a"].to_numpy(), rows["pass"].to_numpy(), list(rows["v"]), window, cosine, split)
        return pd.DataFrame(forest(found), columns=["a", "b"])

    inside = out.where(F.col("border").isNull()).select("a", "b")
    at_borders = out.where(F.col("border").isNotNull()).groupBy("border").applyInPandas(across, "a long, b long")
    return inside.unionByName(at_borders).distinct()


def exact_counts(members: DataFrame, busy: DataFrame, cosine: float, block: int) -> DataFrame:
    """members (component, id, n, v) to (id, n_links): vectors linked inside the component, without the vector itself.

    busy: the largest components, of which there are fewer than HUBS.  The core of a component costs one row each; the
    outliers are compared with their component in blocks, which are spread over tasks.
    """
    half = np.cos(np.arccos(cosine) / 2) + 1e-9
    pivot = members.where(F.col("id") == F.col("component")).select("component", F.col("v").alias("pv"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = (F.size("v") == F.size("pv")) & (dot(F.col("v"), F.col("pv")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("pv"), F.col("pv"))) >= float(half))
    flagged = settle(by_key(members, pivot, busy, "component").withColumn("core", F.coalesce(near, F.lit(False))).drop("pv"))
    sizes = flagged.groupBy("component").agg(F.sum(F.when(F.col("core"), F.col("n")).otherwise(0)).alias("core_n"), F.count_if(~F.col("core")).alias("fringe"), F.count("*").alias("all"))
    core = by_key(flagged.where("core").select("component", "id", "n"), sizes, busy, "component").select("id", (F.col("core_n") - 1).alias("links"))
    own = flagged.where(~F.col("core")).select("id", (F.col("n") - 1).alias("links"))
    # only components that have a fringe go on
    wide = by_key(flagged, sizes.where("fringe > 0"), busy, "component").withColumn("fb", F.ceil(F.col("fringe") / block).cast("int")).withColumn("ab", F.ceil(F.col("all") / block).cast("int"))
    left = wide.where(~F.col("core")).withColumn("f", F.pmod(F.xxhash64("id"), F.col("fb"))).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("ab") - 1))).withColumn("side", F.lit(0))
    right = wide.withColumn("m", F.pmod(F.xxhash64("id"), F.col("ab"))).withColumn("f", F.explode(F.sequence(F.lit(0), F.col("fb") - 1))).withColumn("side", F.lit(1))
    columns = ["component", "f", "m", "side", "id", "n", "core", "v"]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "links": []})
        hit = unit_rows(a["v"]) @ unit_rows(b["v"]).T >= cosine
        hit &= a["id"].to_numpy()[:, None] != b["id"].to_numpy()[None, :]
        back = b["core"].to_numpy()  # a fringe pair is met from both ends, a core one only here
        return pd.DataFrame({"id": np.concatenate([a["id"], b["id"][back]]), "links": np.concatenate([hit @ b["n"].to_numpy(), hit[:, back].T @ a["n"].to_numpy()])})

    crossed = left.select(*columns).unionByName(right.select(*columns)).groupBy("component", "f", "m").applyInPandas(compare, "id long, links long")
    return core.unionByName(own).unionByName(crossed).groupBy("id").agg(F.sum("links").alias("n_links"))


def joined(classes: DataFrame, passes: int, window: int, bits: int, cosine: float, seed: int) -> DataFrame:
    """(id, component) of all classes that link with another: passes until a round of new ones joins no two components."""
    comp, turn = components(candidate_pairs(classes, passes, window, bits, cosine, seed)), 0
    while True:
        turn += 1
        found = candidate_pairs(classes, max(PASSES // 2, passes // 4), window, bits, cosine, seed + turn * 1_000_003)
        for end in "ab":
            found = found.join(comp.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")).hint("merge"), end, "left")
        fresh = settle(found.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct())
        if fresh.isEmpty():
            return comp
        comp = components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(fresh))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, passes: int | None = None, window: int = WINDOW, bits: int = BITS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """One row per vector: id, n_links, component_id (the least id reachable), kept (whether that is its own id).

    Vectors that are null, all zero, or hold null or non-finite components link with nothing.  Vectors of different
    lengths do not link.  Equal vectors always link.  A null id gets component null and is not kept.  Other columns of the
    input are neither read nor returned.  passes: of the first round; without, passes_for() the number of different vectors.
    """
    # single precision stays as it is, at half the size; all sums are formed in doubles
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vid"), F.col(vector_col).cast(kind).alias("v"))
    rows = rows.withColumn("good", usable(F.col("v")))
    good = rows.where("good").withColumn("h", F.xxhash64("v"))
    classes = settle(good.groupBy("h", "v").agg(F.min("vid").alias("least"), F.count("*").alias("n")).withColumn("id", F.xxhash64("h", "v")))
    comp = joined(classes, passes or passes_for(classes.count(), window, cosine), window, bits, cosine, seed)
    members = classes.join(comp.hint("merge"), "id").select("component", "id", "n", "v")
    sizes = comp.groupBy("component").count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    busy = settle(sizes.where(F.col("count") * HUBS > total))
    links = exact_counts(members, busy, cosine, block)
    named = classes.select("id", "h", "v", "least", "n").join(comp.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = by_key(named, least, busy, "component").join(links.hint("merge"), "id", "left").select("h", "v", "component_id", F.coalesce("n_links", F.col("n") - 1).alias("n_links"))
    found = good.join(named.hint("merge"), ["h", "v"]).select("vid", "n_links", "component_id")
    alone = rows.where(~F.col("good")).select("vid", F.lit(0).cast("long").alias("n_links"), F.col("vid").alias("component_id"))
    return found.unionByName(alone).select(F.col("vid").alias(id_col), F.col("n_links").cast("long"), "component_id", F.coalesce(F.col("vid") == F.col("component_id"), F.lit(False)).alias("kept"))


def op5_projection_passes(spark, sf_dir):
    from docloom.llm.shared import read

    return near_duplicates(read(spark, sf_dir, "embeddings"))
