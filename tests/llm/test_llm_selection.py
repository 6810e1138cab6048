"""Decontamination, filter audit and importance resampling against brute force and SQL."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_llm_operators import ODD
from test_oracles import plain

from docloom.llm import decontaminate, filter_audit, resample
from docloom.llm.queries import ORACLES, QUERIES

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string"


def tokens(text):
    return TOKEN.findall((text or "").translate(UPPER))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, "v", 2, "s", 3) for r in ODD]
    return spark.createDataFrame(rows, DOCS + ", id int, items string, th int, part string, rank int")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == columns
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(plain(r[order.index(c)]) for c in columns) for r in found.fetchall())


# --- decontamination


def brute_hits(text, items, window):
    words, hit, found = tokens(text), set(), set()
    for item, body in items:
        theirs = tokens(body)
        n = min(window, len(theirs))
        for i in range(len(theirs) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == theirs[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(found)


def as_row(r):
    return r["n_words"], [k for s in r["spans"] for k in range(s["start"], s["end"])], list(r["items"])


few_words = st.lists(st.sampled_from(["a", "b", "c", "é", "x9", "B"]), max_size=40).map(" ".join)


@given(few_words, st.lists(st.tuples(st.integers(1, 4), few_words), max_size=4), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_shift_tables_miss_nothing(text, items, window):
    words, spans, found = [w.encode() for w in tokens(text)], [], []
    for table in decontaminate.tables([(str(i), " ".join(tokens(t)).encode()) for i, t in items], window):
        table.find(words, spans, found)
    hit = sorted({k for a, b in spans for k in range(a, b)})
    assert (len(words), hit, sorted(set().union(*found))) == brute_hits(text, items, window)
    assert sorted({k for a, b in decontaminate.merged(spans) for k in range(a, b)}) == hit


def test_far_positions_are_skipped():
    table = decontaminate.tables([("1", b"p q r s t u v w x y")], 10)[0]
    looked = []

    class Watched(dict):
        def get(self, key, default):
            looked.append(key)
            return dict.get(self, key, default)

    table.shift = Watched(table.shift)
    table.find([b"%d" % k for k in range(900)], [], [])
    assert len(looked) <= 100


@pytest.mark.parametrize("most_bytes", [decontaminate.MOST_BYTES, 200])
def test_occurrences_in_one_pass_and_in_many(spark, odd, monkeypatch, most_bytes):
    monkeypatch.setattr(decontaminate, "PIECE", 7)  # tasks get it by value: long items are cut
    items = [(1, "one two THREE"), (2, "four five six seven eight nine ten eleven twelve thirteen"), (3, None), (4, ""), (None, "no id"), (2, "nine ten"), (5, "漢字 😀 x"), (6, " ".join(f"w{k}" for k in range(60))), (7, "lorem"), (8, "nothing like it")]
    more = [(9, " ".join(f"w{k}" for k in range(20, 45)), "en", "a"), (10, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13", "en", "a")]
    docs = odd.select("doc_id", "text", "lang", "source", "id", "items").unionByName(spark.createDataFrame([(*r, 1, "v") for r in more], DOCS + ", id int, items string"))
    table = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, th int")
    got = Counter((r["doc_id"], r["n_words"], tuple(as_row(r)[1]), tuple(r["items"])) for r in decontaminate.occurrences(docs, table, most_bytes=most_bytes).collect())
    wanted = Counter()
    for i, text, *_ in [*ODD, *more]:
        n, hit, found = brute_hits(text, items, 10) if len(text or "") < 5000 else (60_000, list(range(0, 60_000, 3)), ["7"])
        wanted[i, n, tuple(hit), tuple(found)] += 1
    assert got == wanted


def test_passes_are_bounded(spark):
    items = spark.createDataFrame([(k, " ".join(f"t{k}x{j}" for j in range(20))) for k in range(200)], "item_id long, text string")
    pieces = decontaminate.pieces_of(items, "item_id", "text", 10)
    part, n = decontaminate.passes_of(pieces, 2000)
    sizes = [r["s"] for r in pieces.groupBy(part.alias("p")).agg({"size": "sum"}).withColumnRenamed("sum(size)", "s").collect()]
    assert n > 5 and max(sizes) <= 4000


def test_nothing_to_find(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r["items"] and not r["spans"] for r in decontaminate.occurrences(odd, none).collect())
    assert decontaminate.occurrences(odd.where("false"), none).count() == 0


# --- filter audit


def failures(rows):
    """Letters that each row fails, by the words of the contract."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A"} if len(words) < 100 else set()
        bad |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        bad |= {"D"} if re.search("[#$%&*|]", t) else set()
        bad |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows) else set()
        out.append(bad)
    return out


def brute_audit(rows, labels):
    bad, out = failures(rows), {}
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], b) for r, b in zip(rows, bad, strict=True) if (r[2] or "") == part]
        removed_by = Counter()
        steps = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for k, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                failing = sum(letter in b for _, b in mine)
                removed_by[letter] += len(gone)
                steps.append((order, k, letter, len(left), len(gone), failing - len(gone), sum(b == {letter} for _, b in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        for order, k, letter, *counts in steps:
            out[part, order, k] = (*counts, removed_by[letter])
    return out


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*filter_audit.METRICS, "shapley")) for r in df.collect()}


def test_audit_equals_brute_force(spark, odd):
    many = " ".join(f"Word{k}" for k in range(120))
    more = [(20, many, "en", "a"), (21, many, "de", "a"), (22, many + " $", "de", "a"), (23, "A B C D", "de", "a"), (24, "a " * 150, "", "a"), (25, many.upper(), None, "a"), (19, many, "fr", "b")]
    labels = [(20, 1, 0), (21, 1, 1), (23, None, 1), (23, 1, None), (None, 1, 1), (5, 0, 1), (99, 1, 1)]
    docs = odd.unionByName(spark.createDataFrame(more, DOCS), allowMissingColumns=True)
    df = filter_audit.audit(docs, spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string"))
    got, wanted = audited(df), brute_audit([*ODD, *more], labels)
    assert len(got) == df.count() == len(wanted) == filter_audit.number_of_rows(5) * len({k[0] for k in wanted})
    assert got == wanted


def test_audit_of_other_rules_and_of_nothing(spark, odd):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = {"S": F.length(F.coalesce("text", F.lit(""))) < 3, "L": F.length(F.coalesce("text", F.lit(""))) > 100}
    rows = audited(filter_audit.audit(odd, labels, rules, None))
    assert {k[1] for k in rows} == {"SL", "LS"} and rows["en", "SL", 1][:2] == (5, 3)
    assert filter_audit.audit(odd.where("false"), labels).count() == 0


def test_audit_holds_thousands_of_parts(spark):
    docs = spark.range(3200).selectExpr("id as doc_id", "concat('x', id) as text", "concat('part', id) as lang")
    out = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.count() == 3200 * 600  # over a million rows of the recursion


# --- resampling


def brute_resample(docs, target, percent=25, least=20, seed=7, buckets=10_000):
    def of(text):
        w = tokens(text)
        return [zlib.crc32(f.encode()) % buckets for f in [*w, *map(" ".join, itertools.pairwise(w))]]

    s, t = (Counter(b for text in side for b in of(text)) for side in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text, *_ in docs:
        f = of(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(tokens(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = defaultdict(list)
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        drawn[r[:4]].append(rank)
    return Counter((*r[:4], drawn[r[:4]].pop(0) if drawn[r[:4]] else None) for r in rows)


@given(st.lists(st.binary(max_size=12), max_size=60))
@settings(max_examples=50, deadline=None)
def test_crcs(features):
    assert resample.crcs(features).tolist() == [zlib.crc32(f) for f in features]


def test_crc_of_a_very_long_word():
    assert resample.crcs([b"x" * 2_000_000, b"y"]).tolist() == [zlib.crc32(b"x" * 2_000_000), zlib.crc32(b"y")]


@pytest.mark.parametrize("at_once", [resample.TOGETHER, 5])
def test_bucket_lists(monkeypatch, at_once):
    texts = ["a b a b", None, "", "c", "a b c é9 B", "..."]
    monkeypatch.setattr(resample, "TOGETHER", at_once)
    got = []
    for at, words in resample.together(texts):
        flat, n = resample.bucket_lists(words, 10_000)
        assert at == len(got)
        for k, end in zip(n.tolist(), n.cumsum().tolist(), strict=True):
            got.append(Counter(flat[end - k : end].tolist()))
    assert got == [Counter(zlib.crc32(f.encode()) % 10_000 for w in [tokens(t)] for f in [*w, *map(" ".join, itertools.pairwise(w))]) for t in texts]


def test_resample_equals_brute_force(spark, odd, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(i, t) for i, t, *_ in ODD] + [(k, " ".join(f"tie{j}" for j in range(30))) for k in (900, 901, 900, None, None)]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, ""]
    df = resample.resample(spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, score int"), spark.createDataFrame([(t,) for t in target], "text string"))
    assert Counter(tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()) == brute_resample(docs, target)


def test_ranks_have_no_gap(spark):
    rows = spark.range(5000).selectExpr("id % 3 as score", "cast(null as long) as id", "id as x")
    assert sorted(r["rank"] for r in resample.ranked(rows, ["score", "id"]).collect()) == list(range(1, 5001))


def test_resample_of_nothing(spark, odd):
    none = odd.where("false")
    assert resample.resample(none, odd).count() == 0
    assert {r["rank"] for r in resample.resample(odd, none).collect()} <= {None, 1}
