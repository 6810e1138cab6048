"""Byte-level BPE by forced-boundary splitting.

A merge can join two bytes only if they stand side by side inside some vocabulary token.  Where a text holds a byte
pair that no token holds, no token can span it: the text is cut there, the fragments are encoded independently, and the
ids are concatenated.  Fragments repeat much more than texts, so each task keeps a bounded table of them.

The pretokenizer's pattern must also see the same borders in a fragment as in the text.  So of all forced pairs, cuts are
made where a non-space is followed by an ASCII space character (no pretoken runs over it, and the pattern's only
look-ahead stands after spaces), and inside runs of ASCII letters or of ASCII digits.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fragments that a worker remembers (twice as many at most), and the longest of them in characters: this bounds its memory.
REMEMBERED, LONGEST = 250_000, 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
class Codec:
    """One vocabulary in one worker: the cuts, the encoder, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, self.special = byte_letters(), {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in self.special} | {i: t.encode() for t, i in self.special.items()}
        seen = {pair for token in self.bytes_of.values() for pair in zip(token, token[1:], strict=False)}
        self.forced = lambda a, b: (a, b) not in seen
        self.cut, self.inner_cut = re.compile(self.pattern()), re.compile(self.inner_pattern())
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads = frozenset("\t\n\x0b\x0c\r ")
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(max(self.bytes_of) + 1)])

    def pattern(self) -> str:
        """A pattern for the empty places before an ASCII space where a text is cut, from the forced pairs.

        What may stand on the left: every character up to U+FFFF that is no white space and whose last byte makes a
        forced pair with the space.
        """
        white = {*map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))}
        lasts = {a for a in range(192) if all(self.forced(a, ord(b)) for b in "\t\n\x0b\x0c\r ")}
        held = [chr(cp) not in white and (cp if cp < 128 else 128 | cp & 63) in lasts for cp in range(0x10000)]
        ranges, cp = [], 0
        while cp < len(held):
            end = cp
            while end < len(held) and held[end]:
                end += 1
            if end > cp:
                ranges.append(rf"\u{cp:04x}-\u{end - 1:04x}")
            cp = end + 1
        return f"(?=[\\t-\\r ])(?<=[{''.join(ranges)}])" if ranges else "(?!)"

    def inner_pattern(self) -> str:
        """The same inside runs of ASCII letters or of digits; tried on long fragments only."""
        cuts = []
        for run in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
            for a in run:
                if right := "".join(b for b in run if self.forced(ord(a), ord(b))):
                    cuts.append(f"(?<={a})(?=[{right}])")
        return "|".join(cuts) or "(?!)"

    def fragments(self, text: str) -> list[str]:
        parts = self.cut.split(text)
        if max(map(len, parts)) > LONGEST:
            return [q for p in parts for q in (self.inner_cut.split(p) if len(p) > LONGEST else (p,))]
        return parts

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.  Special tokens written out in the text are found first."""
        if self.split_special and any(s in text for s in self.special):
            return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self.encode(part) for part in self.split_special.split(text) if part)
        parts, known, older = self.fragments(text), self.known, self.older
        out = list(map(known.get, parts))
        if None in out:
            fresh = []
            for p in {p for p, ids in zip(parts, out, strict=True) if ids is None}:
                if (ids := older.get(p)) is None:
                    fresh.append(p)
                else:
                    known[p] = ids
            if fresh:
                known.update(self.encode_fragments(fresh))
            out = list(map(known.__getitem__, parts))
            for p in fresh:
                if len(p) > LONGEST:
                    del known[p]
            if len(known) > REMEMBERED:
                self.known, self.older = {}, known
        return b"".join(out)

    def encode_fragments(self, fragments: list[str]) -> dict[str, bytes]:
        """Ids of each fragment.  Fragments that may follow one another in a text are encoded in one go and cut again."""
        joined = [p for p in fragments if p[:1] in self.heads and self.cut.search(p + " ", len(p))]
        apart = set(fragments).difference(joined)
        coded = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(apart, self.tokenizer.encode_batch_fast(list(apart), add_special_tokens=False), strict=True)}
        for at in range(0, len(joined), 2000):
            some = joined[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(p.encode()) for p in some])
            to = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * 4
            raw = ids.tobytes()
            coded.update((p, raw[a:b]) for p, a, b in zip(some, (0, *to[:-1].tolist()), to.tolist(), strict=True))
        return coded

    def decode(self, ids: bytes) -> str:
        """What the tokenizers library's decode gives with special tokens kept: bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def clean(text: str | None) -> str:
    return text or ""


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, keep: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and with keep the ids and the decoded text too.

    Null texts count as empty: no token, the hash of nothing.  Whole texts, rows and order within a partition stay.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        codec = Codec(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                rows = []
                for text in texts.slice(at, 256).to_pylist():
                    coded = codec.encode(clean(text))
                    decoded = codec.decode(coded)
                    row = (len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, coded, decoded) if keep else row)
                kinds = (pa.int64(), pa.string(), pa.string(), *((pa.binary(), pa.string()) if keep else ()))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), *columns], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids_le binary, decoded string" * keep
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(("ids_le", "decoded") if keep else ())]
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op8_bpe_round_trip(spark, sf_dir):
    from docloom.llm.shared import read

    return encode_decode(read(spark, sf_dir, "documents"))
