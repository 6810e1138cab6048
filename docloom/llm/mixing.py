"""Mixing sources to target weights by Pfair scheduling.

Rows of a source, in hash order, form blocks.  With weight w, block i (from 0) of a source is released at slot
floor(i / w) and due by slot ceil((i + 1) / w).  Each slot takes the released block with the earliest deadline.  With
weights that sum to one this keeps every source, after every slot, less than one block from its weight's share.

Weights are exact fractions, so nothing drifts however long the schedule is.  When a source has no block left, the schedule
goes on with the other sources at their weights' proportions, from fresh counters.  So all rows are placed.

The schedule is formed in sequence, so its length is bounded: a table has at most about MOST_BLOCKS blocks.  Up to
eight million rows a block has block_rows rows; beyond that blocks grow with the table.  The deviation stays below one block.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import key_of, numbered, settle

#: Blocks about, and sources, that are scheduled at most: they bound what the driver holds.
MOST_BLOCKS, MOST_SOURCES = 1 << 20, 4096
REST = "+"  # begins the key of a lot of sources beyond MOST_SOURCES; no source has it


def phase(left: dict[str, int], weights: dict[str, Fraction], out: dict[str, list[int]], at: int) -> int:
    """Schedule from slot at until a source has no block left; places go to out, left is what remains.  Returns the next slot."""
    scale = math.lcm(*(weights[s].denominator for s in left))
    parts = {s: int(weights[s] * scale) for s in left}
    total = sum(parts.values())
    # integers only: block i of s is released at i * total // parts and due by the ceiling of (i + 1) * total / parts
    ready = [(-(-total // p), s) for s, p in parts.items()]
    heapq.heapify(ready)
    waiting: list[tuple[int, str]] = []
    done, slot = dict.fromkeys(left, 0), 0
    while True:
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // parts[s]), s))
        s = heapq.heappop(ready)[1]
        out[s].append(at + slot)
        done[s] += 1
        slot += 1
        if done[s] == left[s]:
            for x, n in done.items():
                left[x] -= n
            return at + slot
        heapq.heappush(waiting, (done[s] * total // parts[s], s))


def plan(blocks: dict[str, int], weights: dict[str, Fraction]) -> dict[str, list[int]]:
    """The slots of each source's blocks.  Sources of weight zero come after all others, at equal weights."""
    left, out, at = {s: n for s, n in blocks.items() if n}, {s: [] for s in blocks}, 0
    while left:
        active = {s: n for s, n in left.items() if weights[s] > 0}
        at = phase(active, weights, out, at) if active else phase(active := dict(left), dict.fromkeys(left, Fraction(1)), out, at)
        left = {s: n for s, n in (left | active).items() if n}
    return out


def default_weights(counts: dict[str, int], temperature: float = 0.7) -> dict[str, float]:
    """Rows to a power: large sources get less than their share of rows, small ones more."""
    return {s: float(n) ** temperature for s, n in counts.items()}


def target_weights(counts: dict[str, int], weights: dict[str | None, float] | None) -> dict[str, Fraction]:
    """Exact weights by key.  A source that is not named gets the least positive weight named, or 1 if there is none."""
    if weights is None:
        return {k: Fraction(w) for k, w in default_weights(counts).items()}
    if any(not math.isfinite(w) or w < 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    least = min((w for w in weights.values() if w > 0), default=1.0)
    return {k: Fraction(weights.get(k[1:] if k != "~" else None, least)) for k in counts}


def in_lots(rows: DataFrame, sources: DataFrame, id_col: str, block_rows: int, most_blocks: int) -> DataFrame:
    """rows, of sources(__key, count, __weight, __lot), with the lot as __key and __row: 0, 1, 2, ... by a schedule within each lot.

    A lot's schedule is formed in one task from a row a source; its blocks grow as those of a table do.
    """

    def scheduled(lot: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(lot["__key"], lot["count"].tolist(), strict=True))
        size = max(block_rows, -(-sum(counts.values()) // most_blocks))
        slots = plan({s: -(-n // size) for s, n in sorted(counts.items())}, {s: Fraction(w) for s, w in zip(lot["__key"], lot["__weight"].tolist(), strict=True)})
        blocks = sorted((slot, s, k) for s, own in slots.items() for k, slot in enumerate(own))
        out = pd.DataFrame(blocks, columns=["slot", "__key", "__block"])[["__key", "__block"]]
        long = [min(size, counts[s] - k * size) for _, s, k in blocks]
        return out.assign(__lot=lot["__lot"].iloc[0], __size=size, __begin=pd.Series(long, dtype="int64").cumsum() - pd.Series(long, dtype="int64"))

    begins = sources.groupBy("__lot").applyInPandas(scheduled, "__key string, __block long, __lot string, __size long, __begin long")
    begins = settle(begins)
    sizes = begins.groupBy("__key").agg(F.first("__size").alias("__size"))
    own = numbered(rows, "__key", [F.col(id_col), F.col("__tie")], "__at_source").join(sizes.hint("merge"), "__key").withColumn("__block", F.floor(F.col("__at_source") / F.col("__size")))
    met = own.drop("__size").join(begins.hint("merge"), ["__key", "__block"])
    return met.withColumn("__row", F.col("__begin") + F.col("__at_source") % F.col("__size")).withColumn("__key", F.col("__lot")).select(*rows.columns, "__row")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 8, id_col: str = "doc_id", source_col: str = "source", tie_cols: tuple[str, ...] | None = None, most_blocks: int = MOST_BLOCKS, most_sources: int = MOST_SOURCES) -> DataFrame:
    """docs with block, slot and position (0, 1, 2, ... over the whole mix); no row is dropped or repeated.

    weights: target weight by source, any positive scale; without, rows to the power 0.7.  A source that weights does not name
    gets the least weight named; with {} all weigh the same.  Weight 0: after all other sources.  Negative weights are
    an error.  Null is a source of its own.  Beyond most_sources sources, those with the fewest rows are dealt into lots of about
    as many; a lot has the sum of their weights, and its rows come in the order of a schedule of their own, so each source keeps its weight.  The last block of a source may be short.  Rows of a source are ordered by a hash of their id and
    tie_cols (without: text, if there is such a column); repeated rows keep a place each.  An empty table gives an empty result.
    Columns of docs stay, but for any that are called block, slot or position.
    """
    ties = tie_cols if tie_cols is not None else tuple(c for c in ("text",) if c in docs.columns)
    base = docs.drop("block", "slot", "position").withColumn("__tie", F.xxhash64(F.lit(0), *ties)).withColumn("__key", key_of(F.col(source_col)))
    kept = base.columns[:-2]
    by_source = base.groupBy("__key").count()
    counts = {r[0]: r[1] for r in by_source.orderBy(F.desc("count"), "__key").limit(most_sources).collect()}
    named = target_weights(counts, weights)
    total = docs.count()
    few, tail = base, None
    if (rest := total - sum(counts.values())) > 0:
        # the sum of the others' weights, formed by Spark; the rows of a lot meet the main schedule as one source, in the order of the lot's own
        own = F.create_map(*(F.lit(x) for s, w in (weights or {}).items() if s is not None for x in ("=" + s, float(w)))) if weights else None
        least = float(min((w for w in (weights or {}).values() if w > 0), default=1.0))
        weight = F.pow("count", F.lit(0.7)) if weights is None else F.coalesce(own[F.col("__key")], F.lit(least)) if weights else F.lit(1.0)
        held = F.col("__key").isin(list(counts))
        more = settle(by_source.where(~held).withColumn("__weight", weight.cast("double")))
        lots = min(most_sources, -(-more.count() // most_sources))
        more = more.withColumn("__lot", F.concat(F.lit(REST), F.pmod(F.xxhash64("__key"), F.lit(lots)).cast("string")))
        for r in more.groupBy("__lot").agg(F.sum("count").alias("n"), F.sum("__weight").alias("w")).collect():
            counts[r["__lot"]], named[r["__lot"]] = r["n"], Fraction(r["w"])
        few, tail = base.where(held), in_lots(base.where(~held), more, id_col, block_rows, most_blocks)
    size = max(block_rows, -(-total // most_blocks))
    slots = plan({s: -(-n // size) for s, n in counts.items()}, named)
    # only a source's last block may be short; what stands after it moves up
    gaps = sorted((own[-1], size * len(own) - counts[s]) for s, own in slots.items() if size * len(own) > counts[s])
    starts, moved, g = {}, 0, 0
    order = sorted((slot, s) for s, own in slots.items() for slot in own)
    for slot, s in order:
        while g < len(gaps) and gaps[g][0] < slot:
            moved += gaps[g][1]
            g += 1
        starts.setdefault(s, []).append(slot * size - moved)
    table = docs.sparkSession.createDataFrame([(s, own, starts[s]) for s, own in slots.items() if own], "__key string, __slots array<int>, __starts array<long>")
    placed = numbered(few, "__key", [F.col(id_col), F.col("__tie")], "__row", largest=max(counts.values(), default=0))
    placed = placed if tail is None else placed.unionByName(tail)
    # a row a source, and over all of them a number a block: at most about most_blocks
    placed = placed.join(F.broadcast(table), "__key").withColumn("block", F.floor(F.col("__row") / size).cast("long"))
    at = F.col("block").cast("int")
    return placed.select(*kept, "block", F.get("__slots", at).cast("long").alias("slot"), (F.get("__starts", at) + F.col("__row") % size).alias("position"))


def op1_pfair_mixing(spark, sf_dir):
    from docloom.llm.shared import read

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "position")
