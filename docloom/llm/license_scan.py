"""License scan by template-markup matching.

A template is a whole notice with markup: <<optional>> ... <</optional>> may be missing, <<any:a|b>> stands for one of some
wordings, and <<var>> for one or more words of any kind, up to the wording that must follow it, within a paragraph: holders,
years, organisations.  It is compiled into an automaton over words.  A text is accepted if, from some place on, the automaton
reaches its end: all mandatory words stand there, in order and with nothing between them.  Automata start only where the
template's first mandatory words stand, which a plain search finds, and all starts run at once in one pass over the words.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording of notices in public use, with markup.  Signs between words do not count.
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<optional>><<any:1|a>><</optional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<optional>><<any:2|b>><</optional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_CLAUSE = """<<optional>><<any:3|c>><</optional>> Neither the name of <<var>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL <<var>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: A notice names a year or bears the sign; without either the word begins prose.
YEARS = "|".join(map(str, range(1950, 2051)))
TEMPLATES: dict[str, tuple[str, ...]] = {
    "all-rights-reserved": ("All rights reserved",),
    "copyright-notice": ("Copyright <<any:c|©>> <<var>> All rights reserved", f"Copyright <<any:{YEARS}>> <<var>> All rights reserved"),
    "apache-2.0": (
        "Licensed under the Apache License, <<optional>>Version<</optional>> 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<any:this file|this software|these files|this work>> except in compliance with the License.
        You may obtain a copy of the License at <<optional>><<any:http|https>>://<<optional>>www<</optional>> apache.org/licenses/LICENSE-2.0<</optional>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "bsd-2-clause": (f"{BSD_HEAD} {BSD_TAIL}",),
    "bsd-3-clause": (f"{BSD_HEAD} {BSD_CLAUSE} {BSD_TAIL}",),
    "cc-by": (
        "Licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> <<any:CC BY|Creative Commons Attribution>> <<optional>><<any:NC|SA|ND|NC SA|NC ND|NonCommercial|ShareAlike|NoDerivatives|NonCommercial ShareAlike|NonCommercial NoDerivatives>><</optional>> <<any:1.0|2.0|2.5|3.0|4.0>>",
        "This work is licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> Creative Commons Attribution <<optional>><<any:NonCommercial|ShareAlike|NoDerivatives|NonCommercial ShareAlike|NonCommercial NoDerivatives>><</optional>> <<any:1.0|2.0|2.5|3.0|4.0>> <<any:International|Unported|Generic>> License",
    ),
    "cc-by-nc": (
        "Licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> <<any:CC BY|Creative Commons Attribution>> <<any:NC|NC SA|NC ND|NonCommercial|NonCommercial ShareAlike|NonCommercial NoDerivatives>> <<any:1.0|2.0|2.5|3.0|4.0>>",
    ),
    "gpl-2.0": (
        "Licensed under the GNU General Public License <<optional>>as published by the Free Software Foundation<</optional>> <<any:version 2|v2>>",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "gpl-3.0": (
        "Licensed under the GNU General Public License <<optional>>as published by the Free Software Foundation<</optional>> <<optional>>either<</optional>> <<any:version 3|v3>>",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, <<optional>>or (at your option) any later version<</optional>>.
        <<any:This program|<<var>>>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    "isc": (
        """Permission to use, copy, modify, <<any:and|and/or>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
        IN NO EVENT SHALL <<var>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "mit": (
        "Released under the <<any:MIT|Expat>> License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<optional>>(including the next paragraph)<</optional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL <<any:THE AUTHORS OR COPYRIGHT HOLDERS|<<var>>>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<any:http|https>>://<<any:mozilla.org|www.mozilla.org>>/MPL/2.0/""",
    ),
}

#: Bytes that are parts of words, and the lower-cased letters; all others become spaces.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
MARKUP = re.compile(r"<<optional>>|<</optional>>|<<var>>|<<any:|\||>>")
BREAK = re.compile(rb"\n[ \t\r\x0b\x0c]*\n")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(KEPT).split()


class Automaton:
    """Template to states; state k reads one word.  wants[k] is that word, or None for any word; after[k] the next states."""

    def __init__(self, template: str):
        self.wants: list[bytes | None] = []
        self.after: dict[int, set[int]] = {-1: set()}
        tokens, at = [], 0
        for m in MARKUP.finditer(template):
            tokens += [*words_of(template[at : m.start()]), m[0]]
            at = m.end()
        tokens += words_of(template[at:])
        self.head = tokens[: next((k for k, t in enumerate(tokens) if isinstance(t, str)), len(tokens))]
        if not self.head:
            raise ValueError("a template must begin with mandatory words")
        ends, rest = self.build(tokens, 0, {-1})
        if rest < len(tokens):
            raise ValueError("the markup of a template is not closed in order")
        self.start, self.accept = frozenset(self.after[-1]), frozenset(ends)
        self.loops = frozenset(k for k, w in enumerate(self.wants) if w is None)

    def word(self, word: bytes | None, before: set[int]) -> set[int]:
        k = len(self.wants)
        self.wants.append(word)
        self.after[k] = {k} if word is None else set()
        for b in before:
            self.after[b].add(k)
        return {k}

    def build(self, tokens: list, i: int, before: set[int]) -> tuple[set[int], int]:
        """States that tokens from i on end in, and where a closing mark stopped them."""
        while i < len(tokens) and tokens[i] not in ("<</optional>>", "|", ">>"):
            t = tokens[i]
            if t == "<<optional>>":
                inner, i = self.build(tokens, i + 1, before)
                before = before | inner
            elif t == "<<any:":
                ends = set()
                while tokens[i] != ">>":
                    inner, i = self.build(tokens, i + 1, before)
                    ends |= inner
                before = ends
            else:
                before = self.word(None if t == "<<var>>" else t, before)
            i += 1
        return before, i

    def accepts(self, words: list[bytes], starts: list[int], breaks: frozenset[int]) -> bool:
        """Does any start lead to the end?  breaks: places of words that begin a paragraph, where no <<var>> goes on."""
        states: set[int] = set()
        inside: set[int] = set()  # those that go on with a <<var>> or end it
        at = k = 0
        while states or k < len(starts):
            if not states:
                at = starts[k]
            elif self.loops and at in breaks:
                states -= inside
            if k < len(starts) and starts[k] == at:
                states |= self.start
                k += 1
            if at >= len(words):
                return False
            hit = {s for s in states if self.wants[s] in (None, words[at])}
            if hit & self.accept:
                return True
            states = {n for s in hit for n in self.after[s]}
            inside = {n for s in hit & self.loops for n in self.after[s]} if self.loops else set()
            at += 1
        return False


@lru_cache
def automata() -> tuple[tuple[str, Automaton], ...]:
    return tuple((label, Automaton(t)) for label, ts in TEMPLATES.items() for t in ts)


def places(line: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words where a phrase between spaces begins; neighbours may share a space."""
    found, at, before, words, wanted = [], -1, 0, 0, b" " + phrase + b" "
    while (at := line.find(wanted, at + 1)) >= 0:
        words += line.count(b" ", before, at)
        before = at
        found.append(words)
    return found


def paragraphs(text: str) -> frozenset[int]:
    """Numbers of the words that begin a paragraph after an empty line."""
    out, n = [], 0
    for part in BREAK.split(text.encode("utf-8", "surrogatepass"))[:-1]:
        n += len(part.translate(KEPT).split())
        out.append(n)
    return frozenset(out)


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one whole text."""
    text = text or ""
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    base, starts = set(), []
    for phrase, label in PHRASES.items():
        if hits := places(line, phrase.encode()):
            base.add(label)
            starts += hits
    labels, whole, breaks = set(base), False, None
    for label, automaton in automata():
        if at := places(line, b" ".join(automaton.head)):
            breaks = paragraphs(text) if breaks is None else breaks
            if automaton.accepts(words, at, breaks):
                labels.add(label)
                whole = True
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if whole else 0.5 if base else 0.0


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, repeated rows included.  Null and empty texts have no word, no label and score 0.

    labels holds the base labels and the label of every template that the text matches.  score is 1 if a template
    matches, 0.5 if only base phrases stand there, else 0.  A text costs time and memory in proportion to its length,
    however often the first words of a template stand in it.  Other columns are neither read nor returned.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches):
        for batch in batches:
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def op9_license_scan(spark, sf_dir):
    from docloom.llm.shared import read

    return license_scan(read(spark, sf_dir, "documents"))
