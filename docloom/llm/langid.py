"""Language identification with interpolated Kneser-Ney character models.

One model a language, of order 4 over lower-cased letters with a space between words.  The counts of the longest
n-grams are gathered by Spark over all learnable rows; the continuation counts of the shorter ones, the discounts and the
probabilities follow from them in Spark too, and no n-gram is left out.  Each language's model is kept as sorted arrays of
64-bit hashes, one an order, with a log-probability beside each hash: 12 bytes an n-gram, so a model grows with what
its language shows.  A text gets the language with the lowest cross-entropy a character.  The softmax temperature and the
rejection limits are calibrated on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import held_out, settle

ORDER = 4
#: About so many rows, drawn by hash, calibrate temperature and rejection; twice as many at most.
CALIBRATION_ROWS = 4000
MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so the product is a bijection on 64 bits
SPACE = 32


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """Code point to the letter that counts for it: lower case, space for all that is no letter; 16 bits wide."""
    table = np.full(0x110000, SPACE, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = (ord(low) if len(low := c.lower()) == 1 else cp) & 0xFFFF or 1
    return table


def letters(text: str) -> np.ndarray:
    """A whole text as 16-bit letters, runs of others as one space, a space at both ends.  Empty if it has no letter."""
    codes = folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = codes == SPACE
    keep = ~space
    if not keep.any():
        return codes[:0]
    keep[1:] |= ~space[:-1]  # the first space of a run
    codes = codes[keep]
    if codes[0] == SPACE:
        codes = codes[1:]
    return np.concatenate(([SPACE] * (ORDER - 1), codes if codes[-1] != SPACE else codes[:-1], [SPACE])).astype(np.uint16)


def grams(codes: np.ndarray) -> np.ndarray:
    """All n-grams of the longest order, packed: the first letter in the highest bits."""
    c = codes.astype(np.uint64)
    n = len(c) - ORDER + 1
    packed = np.zeros(max(0, n), np.uint64)
    for k in range(ORDER):
        packed = (packed << np.uint64(16)) | c[k : k + max(0, n)]
    return packed


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n) over all rows; each task sums before the shuffle and keeps at most some million entries."""

    def run(batches):
        held: dict[str, list] = {}

        def summed(arrays):
            keys, inverse = np.unique(np.concatenate([a for a, _ in arrays]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([b for _, b in arrays])).astype(np.int64)

        def flush():
            for lang, arrays in held.items():
                keys, n = summed(arrays)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            fresh: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fresh.setdefault(lang, []).append(letters(text))
            for lang, parts in fresh.items():
                keys, n = np.unique(np.concatenate([grams(p) for p in parts] or [np.zeros(0, np.uint64)]), return_counts=True)
                held.setdefault(lang, []).append((keys, n))
                if len(held[lang]) > 8:
                    held[lang] = [summed(held[lang])]
            if sum(len(a) for x in held.values() for a, _ in x) > 2_000_000:
                yield from flush()
        yield from flush()

    rows = docs.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).dropna().mapInArrow(run, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Tables:
    """The model of one language."""

    hashes: list[np.ndarray]  # by order from the longest to 2: sorted hashes of n-grams
    logp: list[np.ndarray]  # the same order: log-probability of the last letter
    back_hashes: list[np.ndarray]  # sorted hashes of contexts, from the longest
    back: list[np.ndarray]  # log of the weight that the shorter order gets after the context
    single: np.ndarray  # 65536: order 1

    def score(self, g: np.ndarray) -> np.ndarray:
        """Log-probability of each packed n-gram's last letter."""
        out, todo = np.zeros(len(g), np.float32), np.arange(len(g))
        for level, (hashes, logp) in enumerate(zip(self.hashes, self.logp, strict=True)):
            part = g[todo] & mask(ORDER - level)
            at, hit = find(hashes, part)
            out[todo[hit]] += logp[at[hit]]
            todo, part = todo[~hit], part[~hit]
            if not len(todo):
                return out
            at, hit = find(self.back_hashes[level], part >> np.uint64(16))
            out[todo[hit]] += self.back[level][at[hit]]
        out[todo] += self.single[(g[todo] & np.uint64(0xFFFF)).astype(np.int64)]
        return out


@dataclass
class Model:
    langs: list[str]
    tables: list[Tables]  # by language
    temperature: float = 1.0
    limit: np.ndarray | None = None  # cross-entropy by language over which a text is rejected

    def cross_entropy(self, codes: np.ndarray) -> np.ndarray:
        """Nats a character, by language.  Long texts go in pieces, so memory is bounded."""
        total, count = np.zeros(len(self.langs)), 0
        for at in range(0, max(0, len(codes) - ORDER + 1), 1 << 18):
            g = grams(codes[at : at + (1 << 18) + ORDER - 1])
            total -= self.score(g).sum(axis=0)
            count += len(g)
        return total / max(1, count)

    def score(self, g: np.ndarray) -> np.ndarray:
        """Log-probability of each packed n-gram's last letter, by language.  Each different n-gram is looked up once."""
        different, inverse = np.unique(g, return_inverse=True)
        return np.stack([t.score(different) for t in self.tables], axis=1)[inverse]

    def scores(self, parts: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy of several texts at once, by row."""
        out = np.zeros((len(parts), len(self.langs)))
        at = 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (size == 0 or size + len(parts[end]) < 1 << 18):
                size += len(parts[end])
                end += 1
            if end - at == 1:
                out[at] = self.cross_entropy(parts[at])
            else:
                gs = [grams(p) for p in parts[at:end]]
                sums = np.vstack([np.zeros((1, len(self.langs))), np.cumsum(self.score(np.concatenate(gs)), axis=0, dtype=np.float64)])
                ends = np.cumsum([len(x) for x in gs])
                starts = np.concatenate(([0], ends[:-1]))
                out[at:end] = -(sums[ends] - sums[starts]) / np.maximum(1, ends - starts)[:, None]
            at = end
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool], list[float]]:
        parts = [letters(t) if t else np.zeros(0, np.uint16) for t in texts]
        ce = self.scores(parts)
        e = np.exp(-(ce - ce.min(axis=1, keepdims=True)) * self.temperature)
        best = ce.argmin(axis=1)
        p = (e / e.sum(axis=1, keepdims=True))[np.arange(len(ce)), best]
        langs, scores, accepted = [], [], []
        for k, part in enumerate(parts):
            known = len(part) > 0
            langs.append(self.langs[best[k]] if known else "und")
            scores.append(float(p[k]) if known else 0.0)
            accepted.append(bool(known and (self.limit is None or ce[k, best[k]] <= self.limit[best[k]])))
        return langs, scores, accepted, [float(c) if len(x) else None for c, x in zip(ce.min(axis=1), parts, strict=True)]


def mask(k: int) -> np.uint64:
    """The bits of the last k letters of a packed n-gram."""
    return np.uint64((1 << (16 * k)) - 1)


def find(hashes: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = packed * MIX
    if not len(hashes):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return at, hashes[at] == h


def hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of packed n-grams and the logarithms of the values beside them."""
    h = keys * MIX
    order = np.argsort(h)
    return h[order], np.log(np.maximum(values[order], 1e-12)).astype(np.float32)


def kneser_ney(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, langs: list[str]) -> Model:
    """Models from (language index, packed n-gram, count) rows in memory: estimate() without Spark, for few rows.

    The longest order is discounted by counts, the shorter ones by the number of different letters seen before an
    n-gram; every discount is n1 / (n1 + 2 n2) of its order.
    """
    vocabulary, tables = len(np.unique(gram & mask(1))) + 1, []
    for i in range(len(langs)):
        g, c, by_order = gram[lang == i], n[lang == i].astype(np.float64), {}
        for k in range(ORDER, 0, -1):
            by_order[k] = (g, c)
            g, c = np.unique(g & mask(k - 1), return_counts=True)
            c = c.astype(np.float64)
        keys, count = by_order[1]
        d, total = discount((count == 1).sum(), (count == 2).sum()), max(1.0, count.sum())
        rest = (d * len(keys) / total if len(keys) else 1.0) / vocabulary
        lower = rest + np.maximum(count - d, 0) / total
        one = Tables([], [], [], [], single_table(keys, lower, rest))
        for k in range(2, ORDER + 1):
            shorter, (keys, count) = keys, by_order[k]
            d = discount((count == 1).sum(), (count == 2).sum())
            contexts, ctx = np.unique(keys >> np.uint64(16), return_inverse=True)
            total = np.bincount(ctx, count, len(contexts))
            weight = np.maximum(d * np.bincount(ctx, minlength=len(contexts)) / total, 1e-9)
            lower = np.maximum(count - d, 0) / total[ctx] + weight[ctx] * lower[np.searchsorted(shorter, keys & mask(k - 1))]
            for store, values, x, y in ((one.hashes, one.logp, keys, lower), (one.back_hashes, one.back, contexts, weight)):
                h, v = hashed(x, y)
                store.insert(0, h)
                values.insert(0, v)
        tables.append(one)
    return Model(langs, tables)


def discount(n1: int, n2: int) -> float:
    return float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5


def single_table(letter: np.ndarray, p: np.ndarray, rest: float) -> np.ndarray:
    """Log-probabilities of order 1: p of the letters seen, rest of any other."""
    single = np.full(65536, rest)
    single[letter.astype(np.int64)] = p
    return np.log(np.maximum(single, 1e-12)).astype(np.float32)


def estimate(counts: DataFrame) -> Model | None:
    """Models from all (lang, gram, n) rows; None if there are none.

    Continuation counts, totals, discounts and probabilities are formed in Spark over all n-grams of every language; the
    driver receives four sums an order and language, and then the finished tables.
    """
    spark = counts.sparkSession
    last = lambda k: F.col("gram").bitwiseAND(F.lit((1 << (16 * k)) - 1).cast("long"))
    orders = {ORDER: settle(counts)}
    for k in range(ORDER - 1, 0, -1):
        orders[k] = settle(orders[k + 1].groupBy("lang", last(k).alias("gram")).agg(F.count("*").alias("n")))
    sums = {}
    for k, rows in orders.items():
        for lang, n1, n2, kinds, total in rows.groupBy("lang").agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count("*"), F.sum("n")).collect():
            sums[lang, k] = discount(n1, n2), kinds, total
    if not sums:
        return None
    langs = sorted({lang for lang, _ in sums})
    vocabulary = orders[1].select("gram").distinct().count() + 1
    rest = {lang: sums[lang, 1][0] * sums[lang, 1][1] / sums[lang, 1][2] / vocabulary for lang in langs}

    def with_discount(k):
        # as many rows as languages
        table = spark.createDataFrame([(lang, sums[lang, k][0]) for lang in langs], "lang string, d double")
        return orders[k].join(F.broadcast(table), "lang")

    whole = F.broadcast(spark.createDataFrame([(lang, float(sums[lang, 1][2]), rest[lang]) for lang in langs], "lang string, total double, rest double"))
    seen = lambda: F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
    p = with_discount(1).join(whole, "lang").select("lang", "gram", (seen() + F.col("rest")).alias("p"))
    found = [(1, False, p)]
    for k in range(2, ORDER + 1):
        rows = with_discount(k).withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("shorter", last(k - 1))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.greatest(F.max("d") * F.count("*") / F.sum("n"), F.lit(1e-9)).alias("weight"))
        lower = p.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("q"))
        p = settle(rows.join(contexts.hint("merge"), ["lang", "context"]).join(lower.hint("merge"), ["lang", "shorter"]).select("lang", "gram", (seen() + F.col("weight") * F.col("q")).alias("p")))
        found += [(k, False, p), (k, True, contexts.select("lang", F.col("context").alias("gram"), F.col("weight").alias("p")))]
    tables = [Tables([], [], [], [], np.zeros(0)) for _ in langs]
    index = F.broadcast(spark.createDataFrame([(lang, i) for i, lang in enumerate(langs)], "lang string, i int"))
    for k, back, rows in found:  # one order at a time; longer ones go before shorter ones
        got = rows.join(index, "lang").select("i", "gram", "p").toArrow()
        owner, keys, values = (got.column(c).to_numpy() for c in ("i", "gram", "p"))
        for i, one in enumerate(tables):
            own = owner == i
            if k == 1:
                one.single = single_table(keys[own], values[own], rest[langs[i]])
                continue
            h, v = hashed(keys[own].view(np.uint64), values[own])
            (one.back_hashes if back else one.hashes).insert(0, h)
            (one.back if back else one.logp).insert(0, v)
    return Model(langs, tables)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """Models of all languages of docs; None if no row has both a text and a language."""
    model = estimate(gram_counts(docs, text_col, lang_col))
    if model is None:
        return None
    langs = model.langs
    index = {x: i for i, x in enumerate(langs)}
    known = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).dropna()
    share = min(1.0, calibration_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("t", "l"), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * calibration_rows).toPandas()
    parts = [letters(t) for t in sample["t"]]
    fits = [(p, index[l]) for p, l in zip(parts, sample["l"], strict=True) if len(p) and l in index]
    if fits:
        ce, truth = model.scores([p for p, _ in fits]), np.array([t for _, t in fits])
        best, gap = None, ce - ce.min(axis=1, keepdims=True)
        for t in np.geomspace(0.5, 64, 29):
            z = -gap * t
            loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean()
            if best is None or loss < best[0]:
                best = (loss, t)
        model.temperature = float(best[1])
        own = [ce[truth == i, i] for i in range(len(langs))]
        model.limit = np.array([np.median(x) + 8 * max(0.05, 1.4826 * np.median(np.abs(x - np.median(x)))) if len(x) else np.inf for x in own])
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, accepted, cross_entropy.

    lang_pred is the language with the lowest cross-entropy a character, ties to the first by name; "und" with score 0 if
    the text is null or has no letter, or if there is no model.  accepted is false for those and for texts whose cross-entropy
    is beyond what calibration saw of their language: the caller may treat them as undetermined.  Nothing but the text is read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shipped.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                langs, scores, accepted, ce = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts), [False] * len(texts), [None] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_()), pa.array(ce, pa.float64())], names)

    names = [id_col, "lang_pred", "score", "accepted", "cross_entropy"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean, cross_entropy double")


def op2_language_id(spark, sf_dir):
    from docloom.llm.shared import read

    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted", "cross_entropy")
