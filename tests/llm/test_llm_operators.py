"""Corpus operators against brute force, invariants and held-out rows."""

from __future__ import annotations

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import bpe, embed_dedup, html_extract, langid, license_scan, mixing, quality_rules, sharding, simhash, toxicity
from docloom.llm.shared import components, held_out, numbered

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (5, "one two three four five six seven eight nine ten eleven", "en", "a"), (5, "one two three four five six seven eight nine ten eleven", "en", "a"),
    (6, LONG, "en", "b"), (7, "ÀÉ naïve £ 漢字 😀 x", "fr", "b"), (None, "no id here", "en", "b"), (8, "x", "en", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash."""
    rows = [(*r, 1, "v", "k", 0, 0, "h") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id int, v string, key string, fp int, shard int, h string")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


# --- shared


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20))
@settings(max_examples=3, deadline=None)
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    wanted = {x: top(x) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["id"]: r["component"] for r in got.collect()} == wanted


def test_components_of_a_long_chain(spark):
    got = components(spark.range(200).selectExpr("id as a", "id + 1 as b"))
    assert {r["component"] for r in got.collect()} == {0} and got.count() == 201


def test_numbers_have_no_gap(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).selectExpr("id", "case when id % 3 = 0 then 'a' else 'b' end as k")
    rows = numbered(df, "k", [F.col("id")], "n", rows_per_part=50).collect()
    for k in "ab":
        assert sorted(r["n"] for r in rows if r["k"] == k) == list(range(sum(r["k"] == k for r in rows)))


# --- 1


def share_of(weights):
    return {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}


@pytest.mark.parametrize(
    ("weights", "blocks"),
    [
        ({"a": 2.0, "b": 1.0}, {"a": 700_000, "b": 350_000}),
        ({f"s{i}": float(n) ** 0.7 for i, n in enumerate([300_000, 1, 17, 80_000, 2_500, 40_000])}, {f"s{i}": n for i, n in enumerate([300_000, 1, 17, 80_000, 2_500, 40_000])}),
        ({"a": 0.61, "b": 0.37, "c": 0.0001}, {"a": 61_000, "b": 37_000, "c": 10}),
        ({f"s{i}": 1.0 + i for i in range(40)}, dict.fromkeys((f"s{i}" for i in range(40)), 500)),
    ],
)
def test_schedule_stays_within_one_block_of_the_given_weights(weights, blocks):
    """Every slot is used once, and until a source ends none is a block off its exact share, after any slot."""
    slots = mixing.plan(blocks, {s: Fraction(w) for s, w in weights.items()})
    assert {s: len(x) for s, x in slots.items()} == blocks
    assert np.array_equal(np.sort(np.concatenate([*slots.values()])), np.arange(sum(blocks.values())))
    end = min(x[-1] for x in slots.values())
    for s, part in share_of(weights).items():
        own = np.array(slots[s])
        k = np.arange(len(own))[own <= end]
        # just before and just after each of its blocks a source is at its furthest from its share
        for slot, i in zip(own[: len(k)][:: max(1, len(k) // 5000)].tolist(), k[:: max(1, len(k) // 5000)].tolist(), strict=True):
            assert -1 < i - part * slot < 1 and -1 < i + 1 - part * (slot + 1) < 1
        assert (np.abs(k + 1 - float(part) * (own[: len(k)] + 1)) < 1 + 1e-6).all() and (np.abs(k - float(part) * own[: len(k)]) < 1 + 1e-6).all()


def test_plan_matches_a_plain_schedule():
    """Block by block from the definition, phases included; weight zero comes last."""
    blocks, weights = {"a": 53, "b": 7, "c": 0, "d": 21, "e": 3}, {"a": 3.0, "b": 1.0, "c": 1.0, "d": 2.0, "e": 0.0}
    left, at, wanted = {s: n for s, n in blocks.items() if n}, 0, {s: [] for s in blocks}
    while left:
        now = share_of({s: weights[s] for s in left if weights[s]} or dict.fromkeys(left, 1.0))
        done, slot, ended = Counter(), 0, False
        while not ended:
            ready = [(math.ceil((done[s] + 1) / w), s) for s, w in now.items() if math.floor(done[s] / w) <= slot]
            s = min(ready)[1]
            wanted[s].append(at + slot)
            done[s], slot = done[s] + 1, slot + 1
            ended = done[s] == left[s]
        at += slot
        left = {s: n - done[s] for s, n in left.items() if n > done[s]}
    assert mixing.plan(blocks, {s: Fraction(w) for s, w in weights.items()}) == wanted
    assert wanted["e"] == [81, 82, 83]


def test_weights(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(30)] + [(30, None)], "doc_id long, source string")
    for weights in ({}, {"a": 0.0}, {"a": 0.0, "b": 0.0, "c": 0.0, None: 0.0}, {"a": 1e-9, "b": 5}, None):
        got = mixing.mix(rows, weights, block_rows=2)
        assert got.columns == ["doc_id", "source", "block", "slot", "position"]
        assert sorted(r["position"] for r in got.collect()) == list(range(31))
    last = mixing.mix(rows, {"a": 0.0}, block_rows=1).orderBy("position").collect()
    assert {r["source"] for r in last[-10:]} == {"a"}
    with pytest.raises(ValueError):
        mixing.mix(rows, {"a": -1.0})


def test_many_sources_and_many_blocks(spark):
    rows = spark.createDataFrame([(i, f"s{i % 50 if i % 2 else 0}") for i in range(1000)], "doc_id long, source string")
    for got in (mixing.mix(rows, most_sources=5).collect(), mixing.mix(rows, {"s1": 3.0}, most_sources=5).collect(), mixing.mix(rows, block_rows=1, most_blocks=64).collect()):
        assert sorted(r["position"] for r in got) == list(range(1000))
    assert max(r["slot"] for r in got) < 64 + 26


def test_mix_keeps_all_rows(spark, odd, nothing):
    rows = mixing.mix(odd, {"a": 0.5, "b": 0.5}, block_rows=2)
    assert rows.columns == [*odd.columns, "block", "slot", "position"]
    got = rows.collect()
    assert sorted(r["position"] for r in got) == list(range(len(ODD)))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in ODD)
    assert mixing.mix(nothing).count() == 0


def test_mix_of_documents_follows_weights(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").drop("position")
    weights = {f"src{i}": 1.0 + (i == 0) * 4 for i in range(20)}
    rows = sorted(mixing.mix(docs, weights, block_rows=1).collect(), key=lambda r: r["position"])
    left, done = Counter(r["source"] for r in rows), Counter()
    share = share_of({s: weights[s] for s in left})
    for t, r in enumerate(rows, 1):
        done[r["source"]] += 1
        assert all(abs(done[s] - t * share[s]) < 1 for s in left)
        if done[r["source"]] == left[r["source"]]:
            break


# --- 2


def naive_kneser_ney(texts, order=4):
    """Probability function of one language from plain dictionaries."""
    grams = Counter()
    for t in texts:
        c = langid.letters(t).tolist()
        grams.update(tuple(c[i : i + order]) for i in range(len(c) - order + 1))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    return counts


def test_models_equal_plain_kneser_ney():
    texts = {"aa": ["the cat sat on the mat", "a cat and a hat"], "bb": ["le chat est là", "un chapeau et le chat là"]}
    langs = sorted(texts)
    counts = {x: naive_kneser_ney(texts[x]) for x in langs}
    rows = [(i, sum(c << (16 * (3 - j)) for j, c in enumerate(g)), n) for i, x in enumerate(langs) for g, n in counts[x][4].items()]
    model = langid.kneser_ney(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64), np.array([r[2] for r in rows]), langs)
    vocabulary = len({g[-1] for x in langs for g in counts[x][4]}) + 1

    def discount(c):
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def p(x, gram):
        if not gram:
            return 1 / vocabulary
        c = counts[x][len(gram)]
        same = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        if not same:
            return p(x, gram[1:])
        total, d = sum(same.values()), discount(c)
        return max(same.get(gram, 0) - d, 0) / total + d * len(same) / total * p(x, gram[1:])

    for text in ("the chat", "zz top", "un mat là"):
        c = langid.letters(text).tolist()
        ours = model.cross_entropy(langid.letters(text))
        for i, x in enumerate(langs):
            grams = [tuple(c[k : k + 4]) for k in range(len(c) - 3)]
            wanted = -sum(math.log(p(x, g)) for g in grams) / len(grams)
            assert ours[i] == pytest.approx(wanted, rel=1e-3)
    together = model.scores([langid.letters("the chat"), np.zeros(0, np.uint16), langid.letters("un mat")])
    assert together[0] == pytest.approx(model.cross_entropy(langid.letters("the chat")), rel=1e-4)


def test_spark_estimate_equals_the_one_in_memory(spark):
    texts = [("the cat sat on the mat", "aa"), ("a cat and a hat", "aa"), ("le chat est là", "bb"), ("un chapeau et le chat là", "bb"), ("漢字 漢字か", "cc"), ("", "dd")]
    counts = langid.gram_counts(spark.createDataFrame(texts, "text string, lang string"), "text", "lang")
    rows = counts.collect()
    langs = ["aa", "bb", "cc"]
    local = langid.kneser_ney(np.array([langs.index(r["lang"]) for r in rows]), np.array([r["gram"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows]), langs)
    model = langid.estimate(counts)
    assert model.langs == langs
    for text in ("the chat", "zz top", "un mat là", "漢字"):
        assert model.cross_entropy(langid.letters(text)) == pytest.approx(local.cross_entropy(langid.letters(text)), rel=1e-5)


def test_a_rare_language_beside_one_of_over_two_million_ngrams(spark):
    rng = np.random.default_rng(5)
    big = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 70_000))) for _ in range(31)]
    rows = [(t, "big") for t in big + big] + [("the cat sat on the mat", "rare")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(8))
    assert model.langs == ["big", "rare"] and len(model.tables[0].hashes[0]) > 2_000_000
    assert model.predict(["a cat on a mat", big[0][:500]])[0] == ["rare", "big"]


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from docloom.llm.langid import op2_language_id

    rows = op2_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_texts(spark, odd, nothing):
    model = langid.train(odd)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t for i, t, *_ in ODD if i == r["doc_id"])
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert langid.train(nothing) is None
    assert {r["lang_pred"] for r in langid.identify(odd, None).collect()} == {"und"}


# --- 3


def naive_fingerprint(text):
    import xxhash

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB \né\x0b Z.", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprints(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_further_signs():
    """The first word is the fingerprint, the others tell as much without repeating it, and texts alike by 0.8 stay within the limit."""
    rng = np.random.default_rng(9)
    apart = []
    for _ in range(200):
        base = [f"w{k}" for k in rng.integers(0, 10**6, 124)]
        copy = base[:100] + [f"v{k}" for k in rng.integers(0, 10**6, 10)] + base[110:]  # 106 of 134 shingles in common
        a, b = (simhash.signs(" ".join(t), 5, 3) for t in (base, copy))
        assert a[0] == simhash.fingerprint(" ".join(base), 5) and len({*a}) == 3
        apart.append([(x ^ y).bit_count() for x, y in zip(a, b, strict=True)])
    apart = np.array(apart)
    assert abs(apart.sum(axis=1).mean() - 29) < 3
    assert (apart.sum(axis=1) > 44).mean() <= 0.02
    assert abs(np.corrcoef(apart.T)[np.triu_indices(3, 1)]).max() < 0.3
    assert simhash.signs(None, 5, 3) == simhash.signs(" \n", 5, 3) == [0, 0, 0]


@pytest.mark.parametrize("blocks", [("golay",), ("golay", "golay"), ("golay", "golay", "hamming")])
def test_near_fingerprints_meet_at_an_anchor(blocks):
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, 60, dtype=np.uint64)
    index, anchor = simhash.anchors(fps.view(np.int64), blocks, 0)
    assert index.tolist() == list(range(60))  # one home each
    home = dict(zip(index.tolist(), anchor.tolist(), strict=True))
    for k, f in enumerate(fps):
        for flips in ([], [5], [0, 22], [23, 45], [7, 40], [50, 63]):
            other = np.array([f ^ np.uint64(sum(1 << b for b in flips))])
            assert home[k] in simhash.anchors(other.view(np.int64), blocks, 2)[1].tolist()


def naive_components(fps):
    ids, parent = list(fps), {i: i for i in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = {r["doc_id"]: naive_fingerprint(r["text"]) for r in docs.collect()}
    wanted = naive_components(fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", wanted[i]) for i, f in fps.items()}


def test_links_of_planted_fingerprints(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    near = np.concatenate([base ^ (1 << rng.integers(0, 62, 40)), base ^ (1 << rng.integers(0, 30, 40)) ^ (1 << rng.integers(31, 62, 40))])
    every = sorted({*base.tolist(), *near.tolist()})
    wanted = {(a, b) for i, a in enumerate(every) for b in every[i + 1 :] if (a ^ b).bit_count() <= 2}
    got = simhash.links(spark.createDataFrame([(x,) for x in every], "fp long"))
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_near_duplicates_of_odd_rows(spark, odd, nothing):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    assert simhash.near_duplicates(nothing).count() == 0


def jaccard_groups(texts, words=5, similarity=0.8):
    """Least index by text index: groups over any path of pairs at the similarity, all pairs compared."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        k = min(words, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(sets)):
        for b in range(a):
            if label[a] != label[b] and (len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def test_sources_beyond_the_most_keep_their_weights(spark):
    """Two heavy and two light sources share what two others leave: the heavy ones come three times as often, as long as all last."""
    rows = [(k, s) for s, n in (("a", 4000), ("b", 3000), ("c", 960), ("d", 960), ("e", 960), ("f", 960)) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, {"a": 1.0, "b": 1.0, "c": 3.0, "d": 3.0, "e": 1.0, "f": 1.0}, most_sources=2).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    order = [r["source"] for r in sorted(got, key=lambda r: r["position"]) if r["source"] in "cdef"]
    heavy, light = sum(s in "cd" for s in order[:1280]), sum(s in "ef" for s in order[:1280])
    assert abs(heavy - 960) <= 32 and abs(light - 320) <= 32


def test_one_of_each_group_of_near_copies(spark, odd, nothing):
    """Against all pairs: no group loses its last text, all surplus copies go but one in a hundred, and only copies go."""
    rng = np.random.default_rng(8)
    vocabulary = [f"w{k}" for k in range(900)]
    base = [[vocabulary[i] for i in rng.integers(0, 900, int(n))] for n in rng.integers(40, 300, 60)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for _ in range(6):
            copy = list(b)
            for at in rng.integers(0, len(copy), max(1, len(copy) // 100)):
                copy[at] = vocabulary[int(rng.integers(0, 900))]
            texts.append(" ".join(copy))
    label = jaccard_groups(texts)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, fp int, th int")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    kept = {r["doc_id"] for r in got.collect()}
    assert {label[i] for i in kept} == set(label)
    assert len(kept) - len(set(label)) <= 0.01 * (len(texts) - len(set(label)))
    rows = simhash.one_of_each(odd).collect()
    assert Counter(r["doc_id"] for r in rows) == {1: 1, 4: 1, 6: 1, 7: 1, None: 1, 8: 1}
    assert simhash.one_of_each(nothing).count() == 0


def test_sketch_has_the_fingerprint_and_all_shingles():
    import xxhash

    for text in ("", " \n", "One two", " ".join(f"W{k % 700}" for k in range(9000))):
        words = text.lower().split()
        grams = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        fp, keys, s = simhash.sketch(text, 5)
        assert fp == keys[0] % 2**64 == simhash.fingerprint(text, 5) and len(keys) == simhash.BANDS + 1
        assert s.view(np.uint32).tolist() == sorted({xxhash.xxh64_intdigest(g, 42) % 2**32 for g in grams})
    assert simhash.sketch("", 5)[1] == simhash.sketch(None, 5)[1] == simhash.sketch("\t", 5)[1]


def test_bands_miss_hardly_a_pair_at_the_limit():
    """Pairs of sets alike by 0.8: the share without a common band is (1 - 0.8 ** 4) ** 16."""
    rng, lost = np.random.default_rng(9), 0
    for _ in range(300):
        words = rng.integers(0, 10**9, 404)
        at = int(rng.integers(0, 200))
        other = [*words[:at], *rng.integers(0, 10**9, 40), *words[at + 40 :]]  # 356 of 444 shingles in common
        a, b = (simhash.sketch(" ".join(map(str, w)), 5) for w in (words, other))
        shared = len(np.intersect1d(a[2], b[2])) / len(np.union1d(a[2], b[2]))
        assert 0.78 < shared < 0.82
        lost += not set(a[1][1:]) & set(b[1][1:])
    assert lost <= 1


def test_no_near_copy_of_a_busy_bucket_is_lost(spark):
    """Forty texts in one bucket, alike two by two: far more pairs than a bucket has firsts."""
    rows = [(1000 + k, [100 * (k // 2) + i for i in range(20)] + [90000 + k]) for k in range(40)]
    marked = spark.createDataFrame(rows, "th long, s array<int>")
    one = spark.createDataFrame([(th, th * 0x9E3779B97F4A7C15 % (1 << 63), [7], len(s)) for th, s in rows], "th long, fp long, keys array<long>, n int")
    got = {(r["th"], r["component"]) for r in simhash.near_copies(marked, one).collect()}
    assert got == {(1000 + k, 1000 + k - k % 2) for k in range(40)}


def test_sets_are_not_handed_on_pair_by_pair(spark, monkeypatch):
    """300 texts in one bucket, alike two by two: pairs that carry their sets stay in proportion to the texts, and no link is lost."""
    handed, held = [], simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda pairs, sets, similarity: handed.append(pairs.count()) or held(pairs, sets, similarity))
    rows = [(1000 + k, [100 * (k // 2) + i for i in range(20)] + [90000 + k]) for k in range(300)]
    marked = spark.createDataFrame(rows, "th long, s array<int>")
    one = spark.createDataFrame([(th, th * 0x9E3779B97F4A7C15 % (1 << 63), [7], len(s)) for th, s in rows], "th long, fp long, keys array<long>, n int")
    got = {(r["th"], r["component"]) for r in simhash.near_copies(marked, one).collect()}
    assert got == {(1000 + k, 1000 + k - k % 2) for k in range(300)}
    assert sum(handed) <= 4 * len(rows)


def test_plain_rows_pass_no_join_for_busy_buckets(spark):
    """The rows of all other buckets are told from busy ones by a filter, so no join hands all of them on."""
    rows = spark.createDataFrame([(k % 300 if k < 600 else 999, k, 10, k) for k in range(1200)], "key long, th long, n int, label long")
    met = simhash.leaders(rows, range(1), 0.8)
    assert met.count() == 1200
    assert "LeftAnti" not in met._jdf.queryExecution().optimizedPlan().toString()


def test_a_chain_of_near_copies_is_one_group(spark):
    """Each text is alike only to its neighbours in the chain, and all share their first words with others that are no copies."""
    words = [f"v{k}" for k in range(1000)]
    chain = [" ".join(words[k * 8 : k * 8 + 160]) for k in range(30)]
    others = [" ".join(words[:60] + [f"z{j}x{k}" for k in range(200)]) for j in range(40)]
    docs = spark.createDataFrame(list(enumerate(chain + others)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == [0, *range(30, 70)]


def test_one_row_stays_where_ids_are_null_or_repeated(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(None, text), (None, text), (None, text + " more"), (7, "other words " * 9), (7, "other words " * 9), (7, "third text of its own here"), (9, None), (8, " ")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:5]) for r in got) == [("7", "other"), ("7", "third"), ("8", " "), ("None", "word0")]


# --- 4


def naive_statistics(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked)


def test_base_statistics_equal_brute_force(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_rules.quality(docs).collect():
        n = naive_statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["base_failed"] and r["kept"])
    got = {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in quality_rules.quality(odd).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[6] == (60_000, 60_000) and len(quality_rules.quality(odd).collect()) == len(ODD)


@given(st.lists(st.sampled_from("ab"), max_size=24))
@settings(max_examples=12, deadline=None)
def test_repeated_windows(spark, words):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(" ".join(words),)], "text string").select(quality_rules.base_statistics(F.col("text")).alias("s")).first()["s"]
    assert row["n_repeat_words"] == naive_statistics(" ".join(words))[4]


def naive_mcd(x, share=quality_rules.SHARE, most_steps=quality_rules.MOST_STEPS):
    """Squared distances by the least determinant of two starts, each by plain concentration steps."""
    floor = np.array(quality_rules.FLOORS)
    grid = lambda v, k: np.floor(v * k + 0.5)
    quantile = lambda v, q: np.percentile(v, 100 * q)

    def estimate(rows):
        mean, cov = rows.mean(axis=0), np.cov(rows.T, bias=True) + np.diag(floor**2)
        return mean, cov

    def distance(e):
        return np.einsum("ij,jk,ik->i", x - e[0], np.linalg.inv(e[1]), x - e[0])

    centre = np.array([quantile(grid(c, 1024), 0.5) for c in x.T])
    spread = np.array([quantile(np.trunc(np.abs(grid(c, 1024) - m)), 0.5) for c, m in zip(x.T, centre, strict=True)])
    starts = [(((x - centre / 1024) / np.maximum(spread * 1.4826 / 1024, floor)) ** 2).sum(axis=1), distance(estimate(x))]
    best = None
    for d2 in starts:
        for _ in range(most_steps):
            logs = grid(np.log(d2 + 1e-6), 64)
            e = estimate(x[logs <= quantile(logs, share)])
            d2 = distance(e)
        if best is None or np.linalg.det(e[1]) < best[0]:
            best = np.linalg.det(e[1]), e
    d2 = distance(best[1])
    return d2 / max(np.exp(quantile(grid(np.log(d2 + 1e-6), 64), 0.5) / 64) / quality_rules.MEDIAN, 1)


def test_distances_equal_plain_estimates(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.2, (300, 4)), rng.normal(3, 0.1, (20, 4))])
    rows = spark.createDataFrame([("g", i, *map(float, r)) for i, r in enumerate(x)], "group string, i int, " + ", ".join(f"{f} double" for f in quality_rules.FEATURES))
    got = quality_rules.outliers(rows).orderBy("i").collect()
    assert np.allclose([r["d2"] for r in got], naive_mcd(x), rtol=0.05)
    assert all(r["outlier"] for r in got[300:]) and sum(r["outlier"] for r in got[:300]) == 0


def test_quality_keeps_labelled_clean_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality_rules.quality(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    assert sum(clean) / len(clean) > 0.99


def test_quality_plan_has_no_python(spark, sf):
    plan = quality_rules.quality(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- 5


def test_links_of_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    near = np.vstack([base[k % 6] + rng.normal(0, 0.02 + 0.1 * (k % 3), 16) for k in range(90)])
    x = np.vstack([base, near, near[:5], 2 * near[:3]])
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, [1.0] * 8), (1005, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, id string, n int")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df, block=16).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert found >= 0.97 * link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (1000, 1001, 1002, 1003))
    assert got[1004]["n_links"] == got[1005]["n_links"] == 1 and got[1005]["component_id"] == 1004
    assert len(got) == len(rows) and embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_recall_on_a_hot_group(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32)
    x = np.vstack([centre + rng.normal(0, 0.05, (400, 32)), rng.normal(size=(300, 32))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df).collect()}
    assert {rows[i]["n_links"] for i in range(400)} == {399} and {rows[i]["component_id"] for i in range(400)} == {0}


def test_passes_go_on_until_none_joins_components(spark):
    rng = np.random.default_rng(6)
    x, noise = rng.normal(size=(150, 32)), rng.normal(size=(150, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    rows = [(i, r.tolist()) for i, r in enumerate(np.vstack([x, y, rng.normal(size=(1500, 32))]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(df, passes=2, window=12).collect()}
    assert sum(got[150 + i]["component_id"] == i for i in range(150)) >= 0.97 * 150


def test_passes_grow_with_the_rows():
    passes = [embed_dedup.passes_for(10**k) for k in range(1, 9)]
    assert passes[0] == embed_dedup.PASSES and passes == sorted(passes) and passes[-1] > 2 * passes[4]


@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=25))
@settings(max_examples=50, deadline=None)
def test_forest_connects_the_same(pairs):
    def groups(edges):
        label = {x: x for e in pairs for x in e}
        for _ in label:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert groups(embed_dedup.forest(np.array(pairs)).tolist()) == groups(pairs)


# --- 6


def test_shards(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sharding.shard(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    load, home, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        home[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert set(load) == set(range(16)) and max(load.values()) < 1.03 * sum(load.values()) / 16
    assert all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = sharding.shard(odd, 4).collect()
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] == 1} == {1}
    assert sharding.shard(nothing).count() == 0


def test_packing_balances_all_measures():
    rng = np.random.default_rng(6)
    items = [(k, int(b), int(b / 6) + 1, int(n)) for k, (b, n) in enumerate(zip(rng.lognormal(8, 1, 3000), rng.integers(1, 9, 3000), strict=True))]
    placed = sharding.pack(items, 16)
    for k in (1, 2, 3):
        load = Counter()
        for x in items:
            load[placed[x[0]]] += x[k]
        assert max(load.values()) < 1.05 * sum(load.values()) / 16


def test_a_hot_text_is_cut(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 3 else f"t{i}" * 4) for i in range(3000)], "doc_id long, text string")
    load, homes = Counter(), set()
    for r in sharding.shard(docs).collect():
        load[r["shard"]] += r["size"]
        homes |= {r["shard"]} if r["size"] == 10 else set()
    assert max(load.values()) < 1.3 * sum(load.values()) / 16 and len(homes) == 9  # 8.3 shards of bytes


def test_a_text_that_fits_a_shard_stays_whole(spark):
    """70 equal rows with a fifth of all words, but a third of a shard of bytes."""
    docs = spark.createDataFrame([(i, "a " * 90 if i < 70 else f"{i}x" * 60) for i in range(3070)], "doc_id long, text string")
    assert len({r["shard"] for r in sharding.shard(docs).collect() if r["doc_id"] < 70}) == 1


def test_placing_against_a_plain_version(spark):
    """Every text is an item here; each goes where the dot product with what is left is highest among the shards it fits."""
    rng = np.random.default_rng(3)
    texts = [" ".join("w" * int(n) for n in rng.integers(1, 9, int(k))) for k in rng.integers(1, 200, 150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:60]])], "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 5, lots=10**9).collect()}
    groups = Counter([*texts, *texts[:60]])
    tie = {r["text"]: f"group {r['h']}.0" for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    size = {t: np.array([n * (len(t.encode()) + 1), n * len(t.split()), n], float) for t, n in groups.items()}
    total = sum(size.values())
    room = np.full((5, 3), 1 / 5)
    load = np.zeros((5, 3))
    for t in sorted(size, key=lambda t: (-(size[t] / total).max(), tie[t])):
        v = size[t] / total
        fits = [s for s in range(5) if (room[s] >= v - 1e-12).all()]
        at = got[texts.index(t)]
        best = max(room[s] @ v for s in fits) if fits else None
        assert at in fits and room[at] @ v > best - 1e-9 if fits else room[at][0] > room[:, 0].max() - 1e-9
        room[at] -= v
        load[at] += v
    assert load.max() < 0.23


# --- 7


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F

    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs.where(held_out(F.col("doc_id"))), model).join(labels, "doc_id").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.85
    assert hit / sum(r["predicted"] for r in rows) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(8)
    y = rng.random(4000) < 0.2
    x = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.8, 0.01), (0.6, 0.02), (0.5, 0.01), (0.1, 0.1))], axis=1).astype(float)
    x = np.hstack([x, x[:, :1]])  # a copy of the first voter
    p, weight = toxicity.label_model(x, np.full(4000, -1))
    assert ((p > 0.5) == y).mean() > 0.93
    assert weight[0] < weight[1] and weight[4] < weight[1]


def test_label_model_equals_plain_expectation_maximisation():
    """Two rounds, before correlations count: against sums row by row from the definition, gold being a voter of its own."""
    rng = np.random.default_rng(5)
    truth = rng.random(900) < 0.2
    x = (rng.random((900, 6)) < np.where(truth[:, None], [0.6, 0.5, 0.4, 0.5, 0.3, 0.6], [0.01, 0.02, 0.01, 0.03, 0.01, 0.02])).astype(float)
    gold = np.where(np.arange(900) % 5 == 0, truth, -1)
    got, weight = toxicity.label_model(x, gold, rounds=2)
    p, right = [0.95 if g == 1 else 0.05 if g == 0 else 0.8 if row.any() else 0.05 for row, g in zip(x, gold, strict=True)], 0.95
    for _ in range(2):
        prior, yes = sum(p) / len(p), sum(p)
        a = [(sum(q for q, r in zip(p, x, strict=True) if r[j]) + 0.5) / (yes + 5) for j in range(6)]
        b = [(sum(1 - q for q, r in zip(p, x, strict=True) if r[j]) + 0.01) / (len(p) - yes + 5) for j in range(6)]
        new = []
        for row, g in zip(x, gold, strict=True):
            one = prior * math.prod(a[j] if v else 1 - a[j] for j, v in enumerate(row)) * (1 if g < 0 else right if g else 1 - right)
            two = (1 - prior) * math.prod(b[j] if v else 1 - b[j] for j, v in enumerate(row)) * (1 if g < 0 else 1 - right if g else right)
            new.append(one / (one + two))
        p = new
        right = min(0.995, max(0.6, np.mean([q if g else 1 - q for q, g in zip(p, gold, strict=True) if g >= 0])))
    assert np.allclose(got, p, atol=1e-9) and (weight == 1).all()
    assert ((got > 0.5) == truth).mean() > 0.97


def test_scores_equal_a_plain_version(spark):
    """Whole scores from the voters as written, against a word by word reading."""
    model = toxicity.Model(["idiot*", "scum", "lo*"], np.array([1.0, 2.0, 0.5, 0.3, 0.2, 0.1, 1.5]), -2.0)
    texts = ["You Idiots, scum of scums; lo and lowe!", "nothing here", "", "scumbag SCUM scum", "xidiot idiot's"]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", t.lower())
        said = [[w for w in words if (w.startswith(v[:-1]) if v.endswith("*") else w == v)] for v in model.voters]
        times, kinds = sum(any(w in x for x in said) for w in words), sum(map(bool, said))
        z = -2 + sum(w for w, x in zip(model.weights, said, strict=False) if x) + float(np.dot(model.weights[3:], toxicity.extras(kinds, times, len(t.split()))))
        assert math.isclose(got[i]["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_toxicity_of_odd_texts(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 0), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(r["predicted"] == 0 for r in rows)
    bad = spark.createDataFrame([(1, "you idiot, you pathetic moron, what trash")], "doc_id long, text string")
    assert toxicity.score(bad, model).first()["predicted"] == 1
    assert toxicity.drop_toxic(odd, model).columns == odd.columns and toxicity.score(nothing, model).count() == 0


# --- 8


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_padding()
    t.no_truncation()
    return t


@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0 　'sàé!?1ab")), max_size=80))
@settings(max_examples=400, deadline=None)
def test_encoding_equals_the_library(reference_tokenizer, text):
    codec = bpe.Codec(bpe.default_vocabulary())
    ids = reference_tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == ids
    assert codec.decode(codec.encode(text)) == reference_tokenizer.decode(ids, skip_special_tokens=False)
    assert "".join(codec.fragments(text)) == text


@pytest.mark.parametrize("text", ["a<|endoftext|>b <|endoftext|>", "<|endoftext", "x" * 5000 + "qzjq" * 50, "don't we'll 'tis  \n\n\n x", "voilà  à la", "\n\nT", "!!'s"])
def test_special_cases_equal_the_library(reference_tokenizer, text):
    codec = bpe.Codec(bpe.default_vocabulary())
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference_tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, sf, odd, nothing, reference_tokenizer):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in bpe.op8_bpe_round_trip(spark, sf).collect():
        ids = reference_tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    rows = bpe.encode_decode(odd, keep=True).collect()
    assert len(rows) == len(ODD) and {(r["n_tokens"], r["decoded"]) for r in rows if r["doc_id"] == 1} == {(0, "")}
    assert bpe.encode_decode(nothing).count() == 0


# --- 9


def naive_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places}))


@given(st.text(alphabet="MmiItT lLicenseCcbBy-\né.", max_size=60))
@settings(max_examples=100, deadline=None)
def test_phrases_equal_brute_force(text):
    text = text + " MIT License mit license" if len(text) % 2 else text
    assert license_scan.scan(text)[:5] == naive_scan(text)


def test_phrases_of_documents(spark, sf, odd, nothing):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in license_scan.op9_license_scan(spark, sf).collect():
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == naive_scan(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    rows = license_scan.license_scan(odd).collect()
    assert len(rows) == len(ODD) and license_scan.license_scan(nothing).count() == 0
    assert {(r["n_words"], r["labels"], r["score"]) for r in rows if r["doc_id"] == 1} == {(0, "", 0.0)}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("Licensed under the Apache License 2.0", "apache,apache-2.0"),
        ("licensed under the Apache License, Edition 2.0", "apache"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by,cc-by-nc"),
        ("released under the Expat license", "mit"),
        ("All rights reserved.", "all-rights-reserved"),
        ("Copyright (c) 1990 The Regents of the University of California. All rights reserved", "all-rights-reserved,copyright-notice"),
        ("Copyright 2020 " + "a b c " * 500 + "all rights reserved", "all-rights-reserved,copyright-notice"),
        ("Copyright 2020 A. Writer\n\nAnother paragraph. All rights reserved", "all-rights-reserved"),
        ("copyright copyright all rights reserved", "all-rights-reserved"),
        ("licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by,cc-by-nc"),
    ],
)
def test_templates(text, labels):
    assert license_scan.scan(text)[5] == ",".join(sorted(set(filter(None, labels.split(",")))))


def filled(template, holder="The Example Project"):
    """A template as a text: optional parts left out, first choices, a holder for each variable part."""
    template = re.sub(r"<<any:<<var>>", "<<any:x", template.replace("|<<var>>>>", ">>"))
    template = re.sub(r"<<any:([^|>]*)[^>]*>>", r"\1", template)
    while "<<optional>>" in template:
        template = re.sub(r"<<optional>>(?:(?!<<optional>>).)*?<</optional>>", "", template, flags=re.S)
    return template.replace("<<var>>", holder)


@pytest.mark.parametrize(("label", "number"), [(x, k) for x, ts in license_scan.TEMPLATES.items() for k in range(len(ts))])
def test_whole_notices_and_altered_ones(label, number):
    text = filled(license_scan.TEMPLATES[label][number])
    one = license_scan.Automaton(license_scan.TEMPLATES[label][number])

    def accepted(t):
        words = license_scan.words_of(t)
        return one.accepts(words, license_scan.places(b" " + b" ".join(words) + b" ", b" ".join(one.head)), license_scan.paragraphs(t))

    assert accepted(f"Some words before. {text}, and after.") and label in license_scan.scan(text)[5].split(",")
    words = text.split()
    assert not accepted(" ".join(words[:-1]))
    if "<<var>>" not in license_scan.TEMPLATES[label][number]:
        for k in range(0, len(words), max(1, len(words) // 9)):
            if license_scan.words_of(words[k]):
                assert not accepted(" ".join([*words[:k], "elsewhere", *words[k:][1:]]))
                assert not accepted(" ".join([*words[: k + 1], "really", *words[k + 1 :]])) or k == len(words) - 1


def expanded(tokens, i=0):
    """All wordings of a small template, by brute force; <<var>> as the mark None."""
    outs = [[]]
    while i < len(tokens) and tokens[i] not in ("<</optional>>", "|", ">>"):
        if tokens[i] == "<<optional>>":
            inner, i = expanded(tokens, i + 1)
            outs = [a + b for a in outs for b in [[], *inner]]
        elif tokens[i] == "<<any:":
            choices = []
            while tokens[i] != ">>":
                inner, i = expanded(tokens, i + 1)
                choices += inner
            outs = [a + b for a in outs for b in choices]
        else:
            outs = [[*a, None if tokens[i] == "<<var>>" else tokens[i]] for a in outs]
        i += 1
    return outs, i


@given(st.text(alphabet="abc", min_size=1, max_size=9))
@settings(max_examples=150, deadline=None)
def test_automata_equal_brute_force(letters):
    words = [c.encode() for c in letters]
    for template in ("a <<optional>>b <<any:a|c c>><</optional>> c", "a <<var>> b", "a b <<any:<<var>> c|a>> <<optional>>b<</optional>> a", "a <<optional>><<var>><</optional>> c <<any:a|b|c>>"):
        one = license_scan.Automaton(template)
        ways, _ = expanded(re.findall(r"<<optional>>|<</optional>>|<<var>>|<<any:|\||>>|[abc]", template))
        pattern = "|".join("".join(".+" if w is None else w for w in way) for way in ways)
        starts = [i for i in range(len(words)) if words[i : i + len(one.head)] == one.head]
        assert one.accepts(words, starts, frozenset()) == bool(re.search(pattern, letters))


def test_many_starts_cost_one_pass(spark):
    text = "copyright permission is hereby granted, " * 40_000
    assert license_scan.scan(text)[0] == 200_000 and license_scan.scan(text)[5] == ""


# --- 10

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy {i}</div><article><h1>Head {i}</h1><p>One &amp; two<br>three</p><p>Four <b>five</b><p>six  {i}<!-- no --><aside>side</aside></article>
<div class="sidebar">side</div><section id="comments"><p>a reader</p></section><form><p>mail</p></form><footer>&copy; x</footer></body></html>"""


def test_articles(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(30)] + [(100, None, None), (101, "x", ""), (102, "http://one.example/", "<p>just &lt;text&gt;"), (102, "http://one.example/", "<p>just &lt;text&gt;"), (103, "http://h.example/x", "<nav>only</nav>")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, host string, id int")
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] < 30:
            assert r["text"] == f"Head {r['page_id']}\n\nOne & two three\n\nFour five\n\nsix {r['page_id']}"
        assert r["n_chars"] == len(r["text"])
    assert {r["text"] for r in got if r["page_id"] in (100, 101, 103)} == {""}
    assert [r["text"] for r in got if r["page_id"] == 102] == ["just <text>"] * 2
    assert html_extract.extract(df.where("false")).count() == 0


def extracted(spark, pages, host="h"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    return [r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_content_without_an_article_element(spark):
    """A menu in plain divs and a constant paragraph are known by the template alone: without one they stay."""
    page = '<html><body><div class="top">Menu x</div><div class="go"><a>Home</a> <a>News {a}</a> <a>All</a></div><div id="wrap"><h2>Title {a}</h2><div class="post"><p>{a} {b}</p><p>Follow us every day</p><p>{b} {a}</p></div></div></body></html>'
    pages = [page.format(a=f"n{i}", b="more words " * 20) for i in range(20)]
    for i, text in enumerate(extracted(spark, pages)):
        words = ("more words " * 20).strip()
        assert text == f"Title n{i}\n\nn{i} {words}\n\n{words} n{i}"
    assert all("Menu x" in t and "Follow us" in t and "Home" in t for t in extracted(spark, pages[:5]))
    assert "Follow us" in "\n\n".join(html_extract.Page(pages[0]).text())


def test_template_by_brute_force(spark):
    """The valid classes of a host are those that a plain comparison of all its pages finds."""
    page = "<html><body><ul>{li}</ul><h4>Latest</h4><div><b>By</b></div><div class='x'>{x}</div>{y}</body></html>"
    pages = [page.format(li="<li>a</li>" * (i % 3 + 1), x=f"text {i} " * 9, y="<p>now and then</p>" * (i % 2)) for i in range(12)]
    rows = spark.createDataFrame([(i, "http://h/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    found, _ = html_extract.templates(html_extract.hosted(rows, "page_id", "url", "html"))
    read = [html_extract.Page(p) for p in pages]
    vectors = defaultdict(list)
    for t in {t for p in read for t in p.sums}:
        vectors[tuple(p.sequence.count(t) for p in read)].append(t)
    wanted = set()
    for vector, tokens in vectors.items():
        orders = {tuple(t for t in p.sequence if t in tokens)[: len(tokens)] for p in read}
        if sum(map(bool, vector)) >= 0.9 * len(pages) and len(tokens) >= 3 and len(orders) == 1:
            wanted |= set(tokens)
    (row,) = found.collect()
    assert set(row["template"]) == wanted and len(wanted) == 8
    assert set(row["constant"]) == {t for t, _, w in read[0].blocks if w in ("Latest", "By")}


def test_copies_are_no_template(spark):
    """Pages that are near copies of one another keep their text."""
    page = "<html><body><article><h1>Same</h1><p>{w}</p><p>only {i}</p></article></body></html>"
    pages = [page.format(i=i, w="the same words again " * 10) for i in range(12)]
    assert all(t.startswith("Same\n\nthe same words") for t in extracted(spark, pages + pages[:1] * 20))


def test_deep_and_long_pages(spark):
    deep = "<div>" * 4000 + "x" + "</div>" * 4000
    long = "<article>" + "".join(f"<p>{k}</p>" for k in range(20_000)) + "</article>"
    got = extracted(spark, [deep, long, "<p>" * 5000 + "y"])
    assert got[0] == "x" and got[1] == "\n\n".join(map(str, range(20_000))) and got[2] == "y"
    assert len(html_extract.Page(deep).sequence) == 4001


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ('<div class="layout with-sidebar"><article class="post social"><p>a</p></article></div>', "a"),
        ('<article><p>a</p></article><article class="comment"><p>b</p></article>', "a"),
        ('<main><h1>t</h1><div class="share">s</div><p>a &lt; b &copy; c</p><div id="comment-list">x</div></main>', "t\n\na < b © c"),
        ("<article><p>a<script>b</script><p>c<!-- d", "a\n\nc"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\n\ntwo\n\nx\n\ny"),
        ("<nav>menu</nav><p>x", "x"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<article><header><h1>Title</h1></header><p class='ad-hoc'>An ad hoc rule</p><p>x <math><mi>y</mi></math> z</p><p id='search-tree'>Search trees</p></article>", "Title\n\nAn ad hoc rule\n\nx y z\n\nSearch trees"),
        ("<article><p>a <object>o</object> <canvas>c</canvas></p><button>b</button></article>", "a o c\n\nb"),
        ("<header>Site</header><div class='story-date'>May</div><div class='story-text'><p>long enough</p></div>", "May\n\nlong enough"),
        ("<div class='site-header'>h</div><div class='ad-slot'>a</div><div class='article-body'><p>text of some length</p></div>", "text of some length"),
        ("<article><p>one</p></article><div class='sidebar-box'>s</div><article><p>two</p></article>", "one\n\ntwo"),
    ],
)
def test_blocks(body, text):
    assert "\n\n".join(html_extract.Page(f"<html><body>{body}</body></html>").text()) == text


def test_pages_of_the_tables(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extract.op10_html_extraction(spark, sf).collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " " if "br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        words = " ".join(b for b in blocks if b).split()
        assert r["text"].split() == words


@pytest.mark.parametrize("n", [9, 40])
def test_constant_parts_of_an_article_stay(spark, n):
    """A heading and a sentence that every page of a host has in its article, with and without a template."""
    page = "<html><body><nav><a href=/>Home</a><a href=/x>X</a><a href=/y>Y</a></nav><article><h1>Title {k}</h1><p>Opening words of number {k}.</p><p>This sentence is on every page.</p><h2>Methods</h2><p>Closing words of number {k}.</p></article><div>Footer line of the host</div></body></html>"
    pages = spark.createDataFrame([(k, "http://h.org/" + str(k), page.format(k=k)) for k in range(n)], "page_id long, url string, html string")
    for r in html_extract.extract(pages).collect():
        k = r["page_id"]
        assert r["text"].split("\n\n") == [f"Title {k}", f"Opening words of number {k}.", "This sentence is on every page.", "Methods", f"Closing words of number {k}."]


def test_only_the_template_tells_menu_and_slogan_in_plain_elements(spark):
    """Without article, kinds and names there is nothing but the template to go by."""
    page = "<html><body><div><div>Acme, the best of all</div><div><a href=/a>One</a><a href=/b>Two</a><a href=/c>Three</a></div></div><div><p>Story {k} begins here and goes on for a while, as such a story does.</p><p>And {k} ends there.</p></div><div>All about Acme since 1990</div></body></html>"
    pages = spark.createDataFrame([(k, "http://acme.org/" + str(k), page.format(k=k)) for k in range(30)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == {k: f"Story {k} begins here and goes on for a while, as such a story does.\n\nAnd {k} ends there." for k in range(30)}
    assert "Acme" in "".join(html_extract.Page(page).text())


def test_what_stands_beside_the_article_in_main_is_text(spark):
    page = "<body><main><div class=lead>Lead</div><article><p>Body</p></article><div>After</div><aside>Other</aside></main><div>Outside</div></body>"
    assert html_extract.Page(page).text() == ["Lead", "Body", "After"]
    assert html_extract.Page("<body><main><p>In main</p></main><article><p>A</p></article></body>").text() == ["A"]


@pytest.mark.parametrize("text", [
    "Copyright law says many things about works in general, and in the end all rights reserved is a phrase.",
    "Copyright is a right. Some say all rights reserved.",
    "The word copyright and all that follows from it: all rights reserved for a few.",
    "Redistribution and use in source and binary forms is a matter of taste.",
    "Licensed under the apple tree he read of version 2.0.",
    "Permission is hereby granted, free of charge, to any person who brings a cake.",
    "Permission to use, copy, modify, and distribute ideas is what makes a school.",
    "This work is licensed under a strange moon.",
    "This program is free software as you may know, and you can redistribute it.",
    "Released under the old licence of the town.",
    "This Source Code Form is subject to the terms of a contract.",
])
def test_prose_is_no_notice(text):
    assert not set(license_scan.scan(text)[5].split(",")) - {"", "all-rights-reserved"}


@pytest.mark.parametrize("text", ["Copyright 2024 Someone. All rights reserved.", "Copyright (c) Some Body, Inc. All rights reserved", "Copyright © 1999-2003 A, B and C. All rights reserved"])
def test_notices_of_copyright(text):
    assert "copyright-notice" in license_scan.scan(text)[5].split(",")
