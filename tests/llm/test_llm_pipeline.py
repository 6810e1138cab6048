"""The pipeline's stages one after the other, on the smallest tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from docloom.llm import quality_rules, toxicity
from test_llm_operators import jaccard_groups


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs = stage(spark, docs, sf).persist()
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {k: sorted(r["doc_id"] for r in v.select("doc_id").collect()) for k, v in kept.items()}
    assert set(ids["quality"]) <= set(ids["toxicity"]) <= set(ids["start"])
    model = toxicity.train(kept["start"], spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids["toxicity"] == sorted(r["doc_id"] for r in toxicity.score(kept["start"], model).where("predicted = 0").collect())
    assert ids["quality"] == sorted(r["doc_id"] for r in quality_rules.quality(kept["toxicity"]).where("kept").collect())
    rows = kept["quality"].orderBy("doc_id").collect()
    label = jaccard_groups([r["text"] for r in rows])
    firsts = {rows[k]["doc_id"] for k in set(label)}
    assert firsts == set(ids["near_dedup"])  # the least of each group stays, and no other copy
    assert ids["mixing"] == ids["near_dedup"] == ids["bpe"]


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_without_rows_or_with_odd_ones(spark, sf, stage):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert stage(spark, docs.where("false"), sf).count() == 0
    good = " ".join(f"plain{k}" for k in range(40))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, good, "en", "a", 1), (2, good, "en", "a", 1), (2, good[::-1], None, "a", 1), (None, good, "en", None, 1), (3, " ".join(f"long{k}" for k in range(60_000)), "en", "a", 1), (4, good, "en", "a", 1)]
    odd = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], docs.schema.add("id", "integer").add("__id", "string").add("fp", "integer").add("position", "integer"))
    got = Counter((r["doc_id"], r["n_tokens"] if "n_tokens" in r.asDict() else (r["text"] or "")[:6]) for r in stage(spark, odd, sf).collect())
    given = Counter((r[0], (r[1] or "")[:6]) for r in rows)
    name = next(n for n, f in corpus_pipeline.STAGES if f is stage)
    if name in ("toxicity", "mixing"):
        assert got == given
    elif name == "quality":
        assert set(got) <= {(2, good[:6]), (2, good[::-1][:6]), (None, good[:6]), (3, "long0 "), (4, good[:6])} and got[2, good[:6]] in (0, 2)
    elif name == "near_dedup":
        assert got == Counter({(1, ""): 1, (2, good[:6]): 1, (2, good[::-1][:6]): 1, (3, "long0 "): 1})
    else:
        assert sum(got.values()) == len(rows) and got[1, 0] == 2 and got[None, 0] == 1
