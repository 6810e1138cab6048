"""Toxicity by weak supervision.

Voters are words and word beginnings: a small fixed lexicon, and those that labelled rows show to go with toxicity.  A
voter speaks if it occurs.  A generative model, fitted by expectation maximisation on a bounded sample of learnable rows,
estimates how often each voter speaks given either class, and from what the voters still have in common given the class,
how much each should count.  Gold labels, where there are any, are one more voter with an accuracy of its own.  A linear
classifier on voters and their density is trained on the posterior labels.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import fold, held_out

#: About so many labelled rows, drawn by hash, fit the model; twice as many at most.
FIT_ROWS = 20_000
MOST_VOTERS, LEAST_ROWS, LEAST_LOG_ODDS = 400, 4, 2.5
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: Fixed lexicon of insults, lower case; "*" stands for any ending.
LEXICON = "idiot* moron* stupid* loser* scum* trash worthless pathetic disgusting clown* imbecil* dumb* bastard* scumbag* vermin filth* crétin* connard* abruti* dummkopf* vollidiot* arschloch* abschaum estúpid* imbécil* basura gilipollas".split()


def letter(c: str) -> bool:
    return c.isalpha()


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of voters, then of density, kinds and any
    bias: float = -3.0

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, v in enumerate(self.voters):
            a.add_word(v.rstrip("*"), ([k], len(v.rstrip("*")), v.endswith("*"))) if v.rstrip("*") not in a else None
        for k, v in enumerate(self.voters):  # a word and a beginning may have the same letters
            held = a.get(v.rstrip("*"))
            if k not in held[0]:
                a.add_word(v.rstrip("*"), (held[0] + [k], held[1], held[2] or v.endswith("*")))
        a.make_automaton()
        return a

    def hits(self, text: str | None, automaton) -> tuple[list[int], int, int]:
        """(voters that speak, how often any does, words) of a whole text."""
        low, found, times = (text or "").lower(), set(), 0
        n = len(low)
        for end, (ids, size, _) in automaton.iter(low) if low and len(automaton) else ():
            start = end - size + 1
            if start and letter(low[start - 1]):
                continue
            closed = end + 1 == n or not letter(low[end + 1])
            said = [k for k in ids if closed or self.voters[k].endswith("*")]
            found.update(said)
            times += bool(said)
        return sorted(found), times, len(low.split())

    def score(self, speaking: list[int], times: int, words: int) -> float:
        z = self.bias + self.weights[speaking].sum() + float(np.dot(self.weights[len(self.voters) :], extras(len(speaking), times, words)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def extras(kinds: int, times: int, words: int) -> list[float]:
    return [np.log1p(100 * times / (words + 20)), np.log1p(times), np.log1p(kinds), float(times > 0)]


def mined(labelled: DataFrame) -> list[str]:
    """Words and beginnings that go with toxicity in (text, toxic) rows: by Spark, counting each once a row."""
    import re

    def run(batches):
        word = re.compile(r"[^\W\d_]+")
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(word.findall(text.lower()))
                for feature in words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) >= k}:
                    counts.setdefault(feature, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["feature", "clean", "toxic"])

    counted = labelled.mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    total = labelled.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    odds = F.log((F.col("toxic") + 0.5) / (total[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (total[0] + 1.0))
    rows = counted.where(F.col("toxic") >= LEAST_ROWS).withColumn("odds", odds).where(F.col("odds") >= LEAST_LOG_ODDS).orderBy(F.desc(F.col("odds")), F.desc("toxic"), "feature").limit(MOST_VOTERS * 10).collect()
    odds_of = {r["feature"]: r["odds"] for r in rows}
    seen = {r["feature"]: (r["clean"], r["toxic"]) for r in rows}
    for f in [f for f in seen if f.endswith("*")]:  # of beginnings that speak in the same rows the longest says most exactly what is meant
        for shorter in (f[:k] + "*" for k in range(PREFIXES[0], len(f) - 1)):
            if seen.get(shorter) == seen[f]:
                odds_of.pop(shorter, None)
    kept: list[str] = []
    for f in sorted(odds_of, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"), f)):
        stem = f.rstrip("*")
        # a beginning that speaks in all those rows, with odds nearly as good or better, makes a longer one needless
        if not any(odds_of.get(b, -9) >= odds_of[f] - 0.7 for k in range(PREFIXES[0], len(stem) + 1) if (b := stem[:k] + "*") != f):
            kept.append(f)
    return sorted(kept, key=lambda f: (-odds_of[f], f))[:MOST_VOTERS]


def label_model(x: np.ndarray, gold: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of toxicity by row and weight by voter, from votes x (rows x voters, 0/1) and gold (1, 0, or -1: none)."""
    n, width = x.shape
    p = np.clip(np.where(gold >= 0, gold * 0.9 + 0.05, np.where(x.sum(axis=1) > 0, 0.8, 0.05)), 0.02, 0.98)
    weight, right = np.ones(width), 0.95
    for step in range(rounds):
        prior = np.clip(p.mean(), 0.005, 0.6)
        a = np.clip((x.T @ p + 0.5) / (p.sum() + 5.0), 1e-5, 0.99)
        b = np.clip((x.T @ (1 - p) + 0.01) / ((1 - p).sum() + 5.0), 1e-6, 0.99)
        if step == 2 and width > 1:  # what two voters share beyond the class: correlated voters count for less
            rest = x - np.outer(p, a) - np.outer(1 - p, b)
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
            shared = np.abs(rest.T @ rest / n / np.outer(spread, spread))
            np.fill_diagonal(shared, 0)
            weight = 1 / (1 + np.where(shared > 0.1, shared, 0).sum(axis=1))
        said, silent = np.log(a / b) * weight, np.log((1 - a) / (1 - b)) * weight
        z = np.log(prior / (1 - prior)) + x @ (said - silent) + silent.sum()
        z += np.where(gold >= 0, (2 * gold - 1) * np.log(right / (1 - right)), 0)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if (gold >= 0).any():
            right = float(np.clip(np.where(gold == 1, p, 1 - p)[gold >= 0].mean(), 0.6, 0.995))
    return p, weight


def linear(features: np.ndarray, target: np.ndarray, strength: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the bias.

    Nothing speaks against toxicity here: features whose weight comes out negative are left out and the rest is fitted anew.
    """
    use = np.ones(features.shape[1], bool)
    while True:
        x, w = np.hstack([features[:, use], np.ones((len(features), 1))]), np.zeros(use.sum() + 1)
        held = np.append(strength[:-1][use], strength[-1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (p - target) + held * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        if (w[:-1] >= 0).all():
            break
        use[np.flatnonzero(use)[w[:-1] < 0]] = False
    out = np.zeros(features.shape[1] + 1)
    out[np.append(use, True)] = w
    return out


def voted(rows: DataFrame, model: Model, columns: list[str], text_col: str) -> DataFrame:
    """rows' columns and the voters that speak, how often, and the words."""

    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            out = [model.hits(t, automaton) for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], [*columns, "speaking", "times", "words"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select(*columns, F.col(text_col).cast("string")).mapInArrow(run, f"{schema}, speaking array<long>, times long, words long")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on learnable rows of docs (crc32(id) mod 3 not 1) and their labels.  Without labels the fixed lexicon decides.

    Labels other than 0 and 1 do not count; an id with several labels is toxic if one says so.  Null texts teach nothing, empty
    ones show no voter.  Repeated rows count each.  Whole texts are read, however long, and every voter counts once a text.
    """
    gold = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("gid")).agg(F.max(label_col).cast("int").alias("toxic"))
    share = min(1.0, fit_rows / max(1, gold.count()))
    gold = gold.where((F.pmod(F.xxhash64("gid"), F.lit(1_000_000)) < int(share * 1_000_000)) & (fold(F.col("gid")) != 1))
    learnable = docs.where(~held_out(F.col(id_col))).select(F.col(id_col).alias("gid"), F.col(text_col).cast("string").alias("text"))
    labelled = learnable.join(gold.hint("merge"), "gid").where(F.col("text").isNotNull()).select("text", "toxic")
    found = mined(labelled)
    model = Model([*found, *(w for w in LEXICON if w not in found)])
    rows = voted(labelled.select("toxic", "text"), model, ["toxic"], "text").limit(2 * fit_rows).toPandas()
    width = len(model.voters)
    x = np.zeros((len(rows), width))
    for k, said in enumerate(rows["speaking"]):
        x[k, np.asarray(said, np.int64)] = 1
    if not len(rows) or rows["toxic"].nunique() < 2:
        model.weights, model.bias = np.concatenate([np.full(width, 1.0), [1.0, 0.5, 1.0, 2.0]]), -3.0
        return model
    posterior, _ = label_model(x, rows["toxic"].to_numpy())
    more = np.array([extras(len(s), t, w) for s, t, w in zip(rows["speaking"], rows["times"], rows["words"], strict=True)])
    w = linear(np.hstack([x, more]), posterior, np.concatenate([np.full(width, 2.0), [0.05, 0.05, 0.05, 0.05, 0.01]]))
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (1 if score reaches the threshold).

    Null and empty texts get the score of a text without any voter.  Only the text is read.  Repeated rows stay.
    """

    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            scores = [model.score(*model.hits(t, automaton)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that the model calls toxic; all columns stay."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        automaton = model.automaton()
        for batch in batches:
            keep = pa.array([model.score(*model.hits(t, automaton)) < threshold for t in batch.column(at).to_pylist()], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, schema)


def op7_toxicity(spark, sf_dir):
    from docloom.llm.shared import read

    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
