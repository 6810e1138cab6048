"""Embedding with bad texts, the hashed stand-in, the gate over a dataset and stable samples."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.operators import quality as ql
from docloom.operators import vectors as vx


def counted(bad):
    calls = []

    def embedder(texts):
        calls.append(len(texts))
        if texts.isin(bad).any():
            raise ValueError("cannot read")
        return texts.map(lambda t: [float(len(t))])

    return embedder, calls


@pytest.mark.parametrize("n", [1, 2, 7, 256, 1000])
def test_one_bad_text_costs_one_row_and_two_calls_a_halving(n):
    embedder, calls = counted(["bad"])
    texts = pd.Series(["t" * (k % 5) for k in range(n)])
    texts[n // 3] = "bad"
    found, errors = vx.isolated(embedder, texts)
    assert [k for k, e in enumerate(errors) if e] == [n // 3] and errors[n // 3] == "ValueError: cannot read"
    assert all(v == [len(t)] for t, v, e in zip(texts, found, errors, strict=True) if not e) and found[n // 3] is None
    assert len(calls) <= 1 + 2 * math.ceil(math.log2(n) if n > 1 else 0)


def test_batches_without_and_with_only_bad_texts():
    embedder, calls = counted(["bad"])
    assert vx.isolated(embedder, pd.Series([], dtype=object)) == ([], []) and calls == []
    assert vx.isolated(embedder, pd.Series(["a", "b"])) == ([[1.0], [1.0]], ["", ""]) and calls == [2]
    assert vx.isolated(embedder, pd.Series(["bad", "bad"])) == ([None, None], ["ValueError: cannot read"] * 2)


def test_an_embedder_that_loses_rows_is_an_error_of_those_rows():
    found, errors = vx.isolated(lambda t: [[1.0]] * (len(t) if len(t) == 1 and t.iloc[0] == "a" else 0), pd.Series(["a", "b"]))
    assert found == [[1.0], None] and errors == ["", "ValueError: 0 vectors for 1 texts"]


def test_embed_keeps_the_other_texts(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, None), (4, "b")], "id int, t string").coalesce(1)

    def embedder(texts):
        if texts.eq("bad").any():
            raise RuntimeError("no")
        return texts.map(lambda t: [float(len(t or ""))])

    got = {r.id: (r.v, r.error) for r in vx.embed(docs, "t", embedder).collect()}
    assert got == {1: ([2.0], ""), 2: (None, "RuntimeError: no"), 3: ([0.0], ""), 4: ([1.0], "")}


def plain_vector(texts, size):
    v = [0] * size
    for t in texts:
        c = [ord(x) for x in f" {t.lower()} "] if t is not None else []
        for i in range(len(c) - 2):
            v[((c[i] * 7919 + c[i + 1]) * 104729 + c[i + 2]) % 1_000_003 % size] += 1
    length = max(math.sqrt(sum(x * x for x in v)), 1e-9)
    return [x / length for x in v]


def test_hashed_vectors_against_a_plain_loop(spark):
    texts = ["", None, "a", "Straße 𝐚𝐛 文書", "x" * 30_000, "one two", "shared"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(6, "id"), (None, "null id")]
    got = {r.id: r.v for r in vx.hashed_vectors(spark.createDataFrame(rows, "id int, t string"), "id", "t", 16).collect()}
    by = {}
    for k, t in rows:
        by.setdefault(k, []).append(t)
    assert set(got) == set(by)
    for k, ts in by.items():
        assert got[k] == pytest.approx(plain_vector(ts, 16), abs=1e-12)
    plan = vx.hashed_vectors(spark.createDataFrame(rows, "id int, t string"), "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert vx.hashed_vectors(spark.createDataFrame([], "id int, t string"), "id", "t").count() == 0


ROWS = "extraction_status string, category string, extension string, text string"
DOMAINS = {"category": ["a", "b", "c"], "extension": ["pdf", "txt"]}


def gates(spark, tmp_path, rows, expected, **more):
    frame = spark.createDataFrame(rows, ROWS)
    read = ql.dataset_gate(frame, expected, text_col="text", domains=DOMAINS, **more).first().asDict()
    seen = ql.write_gated(frame, f"{tmp_path}/out", expected, text_col="text", domains=DOMAINS, **more).first().asDict()
    assert read == seen and spark.read.parquet(f"{tmp_path}/out").count() == len(rows)
    return read


def test_each_rule_of_the_gate(spark, tmp_path):
    good = [("success", "abc"[k % 3], ["pdf", "txt", "md", None][k % 4], "가나") for k in range(12)]
    assert gates(spark, tmp_path, good, 12, skew=0.5)["failures"] == [] and gates(spark, tmp_path, good, 12, skew=0.5)["passed"]
    odd = [*good[:3], ("ok", "x", "pdf", "bad �"), ("error", None, "pdf", None), ("success", "a", "pdf", "t")]
    odd = [r for r in odd if r[1] != "c"]
    assert gates(spark, tmp_path, odd, 9)["failures"] == ["row_count", "unexpected_status", "missing_category:c", "unknown_category", "skew_category:a", "skew_category:other", "skew_extension:pdf", "replacement_characters"]
    assert gates(spark, tmp_path, [("error", "a", "pdf", "")], 1, closed=())["failures"] == ["no_success", "skew_category:a", "skew_extension:pdf"]


def test_the_gate_of_an_empty_table(spark, tmp_path):
    assert gates(spark, tmp_path, [], 0)["failures"] == ["no_success", "missing_category:a", "missing_category:b", "missing_category:c"]


def test_stable_sample_against_a_plain_loop(spark):
    rows = [(k % 30, k * 7 % 50, f"v{k % 3}") for k in range(200)]
    frame = spark.createDataFrame(rows, "i int, at int, v string")
    last = {}
    for i, a, v in rows:
        last[i] = max(last.get(i, (-1, "")), (a, v))
    drawn = sorted(last, key=lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest())[:10]
    want = [(i, *last[i]) for i in drawn]
    for parts in (1, 7):
        assert [tuple(r) for r in ql.stable_sample(frame.repartition(parts), "i", 10, order="at").collect()] == want
    assert [r.i for r in ql.stable_sample(frame.select("i"), "i", 10).collect()] == drawn
    assert ql.stable_sample(frame.limit(0), "i", 10, order="at").count() == 0
    assert ql.stable_sample(frame.withColumn("i", F.lit(None).cast("int")), "i", 10, order="at").count() == 1
