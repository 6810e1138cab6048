"""The word index against plain substring search: built, followed and compacted."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.functions.text import SEPARATORS
from docloom.operators import postings
from docloom.operators.postings import WordIndex

SCHEMA = "id long, name string, body string, mtime_us long, word string, gram string, token string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "w", "g", "t") for r in rows], SCHEMA)


def brute(rows, tokens):
    out = set()
    for i, name, body, *_ in rows:
        flat, low = re.sub(rf"{SEPARATORS}|\s", "", name or "").lower(), (body or "").lower()
        out |= {(t, i, t in flat) for t in tokens if t and (t in flat or t in low)}
    return out


def found(index, spark, tokens):
    rows = index.matches(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()
    out = {(r["token"], r["id"], r["in_name"]) for r in rows}
    assert len(out) == len(rows)
    return out


FIRST = [(1, "Alpha Report.pdf", "the quick brown fox, the lazy dog", 5), (2, None, None, 5), (3, "b.txt", "", 5), (4, "x-y z.md", "Straße ÀÉ 漢字テスト naïve break here", None), (5, "long.txt", "word " * 50_000 + "ende", 5), (6, "fox.txt", "no animal", 5)]
TOKENS = ["fox", "al", "a", "the", "quickbrown", "xyz", "zmd", "字", "漢字", "naïve", "break", "here", "ende", "wor", "absent", "q", "alphareport", "ïveb", "ß"]


def test_index_follows_the_catalog(spark, tmp_path):
    index = WordIndex(spark, str(tmp_path / "ix")).build(table(spark, FIRST))
    assert found(index, spark, TOKENS) == brute(FIRST, TOKENS)
    assert index.update(table(spark, FIRST)) == 0 and index.segments() == [0]
    # one text changed, one came, two went, one has another time but the same text
    second = [(1, "Alpha Report.pdf", "now a cat", 6), (2, None, None, 5), (4, "x-y z.md", FIRST[3][2], 9), (5, "long.txt", FIRST[4][2], 5), (7, "new.txt", "the fox", 1)]
    assert index.update(table(spark, second)) == 5 and index.segments() == [0, 1]
    assert found(index, spark, TOKENS) == brute(second, TOKENS)
    third = [*second, (6, "fox.txt", "back again", 5)]
    assert index.update(table(spark, third)) == 1
    assert found(index, spark, TOKENS) == brute(third, TOKENS)
    index.compact()
    assert index.segments() == [3] and found(index, spark, TOKENS) == brute(third, TOKENS)
    assert {(r["id"], r["mtime_us"]) for r in index.stored().collect()} == {(r[0], r[3]) for r in third}


@given(st.lists(st.text("abB é_.", max_size=12), min_size=1, max_size=6), st.lists(st.text("abé", min_size=1, max_size=5), min_size=1, max_size=6))
@settings(max_examples=4, deadline=None)
def test_index_equals_substring_search(spark, tmp_path_factory, texts, tokens):
    rows = [(k, t[::-1], t, 0) for k, t in enumerate(texts)]
    index = WordIndex(spark, str(tmp_path_factory.mktemp("ix"))).build(table(spark, rows))
    assert found(index, spark, tokens) == brute(rows, tokens)


def test_many_words_met_are_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "MOST_MET", 2)
    index = WordIndex(spark, str(tmp_path / "ix")).build(table(spark, FIRST))
    out = index.matches(spark.createDataFrame([(t,) for t in TOKENS], "token string"))
    assert "SortMergeJoin" in out._jdf.queryExecution().toString()
    assert {(r["token"], r["id"], r["in_name"]) for r in out.collect()} == brute(FIRST, TOKENS)


def test_empty_index_and_no_tokens(spark, tmp_path):
    index = WordIndex(spark, str(tmp_path / "ix")).build(table(spark, []))
    assert found(index, spark, ["a"]) == set()
    assert index.update(table(spark, FIRST)) == len(FIRST) and found(index, spark, TOKENS) == brute(FIRST, TOKENS)
    assert found(index, spark, []) == set() and found(index, spark, [""]) == set()


def test_one_pass_equals_substring_search(spark, sf, monkeypatch):
    """Many words at once are looked for in one pass: no index is built for that, and each pair comes once."""
    monkeypatch.setattr(WordIndex, "build", lambda *a: pytest.fail("an index was built"))
    rows = postings.scanned(spark.createDataFrame([(t,) for t in TOKENS], "token string"), table(spark, FIRST)).collect()
    out = {(r["token"], r["id"], r["in_name"]) for r in rows}
    assert len(out) == len(rows) and out == brute(FIRST, TOKENS)
    assert postings.scanned(spark.createDataFrame([], "token string"), table(spark, FIRST)).count() == 0
    assert postings.scanned(spark.createDataFrame([("fox",)], "token string"), table(spark, [])).count() == 0
    from docloom.registry import search

    assert search.d1_lexical_candidates(spark, sf).count() > 0


def test_no_python_in_the_search(spark, sf):
    from docloom.registry import search

    plan = search.d1_lexical_candidates(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_too_many_words(spark, tmp_path):
    index = WordIndex(spark, str(tmp_path / "ix")).build(table(spark, FIRST))
    with pytest.raises(ValueError, match="batches"):
        index.matches(spark.range(20_001).selectExpr("concat('w', id) as token"))
