r"""License scan by a generalised suffix automaton of licence tokens.

All templates and short phrases go into one suffix automaton over their words.
A text streams through it, and the automaton gives the matching statistics:
after each word, the length of the longest suffix that occurs in some
template, and where. Phrases are recognised by marks along suffix links: a
phrase of k words ends at a word if the state (or one that it links to) is
marked and the match is at least k long. Maximal matches of at least MIN words
in a template are anchors; anchors of a template that keep its order and stay
near each other are chained, and the words of the template that a chain covers
give its span and score. A template whose chain covers enough is a label.

Words: A-Z lower-cased, cut at ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``'s complement,
which is to say that ASCII letters, digits and all bytes from 0x80 on are
parts of words.

Cases: null and empty texts have no words, no labels and score 0; a text that
repeats a licence counts each place; a word that is in no template ends every
match. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Phrases that count wherever they stand, and their labels: fixed values.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Whole texts of short licences, without their copyright lines: fixed values.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as
such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright
laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the
public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: Whole texts, and of long licences the notices that stand in files that are under them (load() takes whole ones from a folder): fixed values.
TEMPLATES = (
    ("mit", MIT),
    ("bsd-2", f"{BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("bsd-3", f"{BSD_CONDITIONS} {BSD_THIRD} {BSD_DISCLAIMER}"),
    ("isc", ISC),
    ("zlib", ZLIB),
    ("unlicense", UNLICENSE),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("all-rights-reserved", "copyright all rights reserved no part of this publication may be reproduced stored or transmitted in any form or by any means without the prior written permission of the publisher"),
)


def load(folder: str) -> tuple[tuple[str, str], ...]:
    """Templates from a folder of the driver: a label for each file name, and its whole text."""
    found = sorted(os.listdir(folder))
    texts = [(name.removesuffix(".txt").lower(), os.path.join(folder, name)) for name in found if os.path.isfile(os.path.join(folder, name))]
    return tuple((label, open(path, encoding="utf-8", errors="replace").read()) for label, path in texts)


#: Words of a match that may join a chain; words that may lie between two of them; the share of a template that makes a label.
MIN, GAP, ENOUGH = 5, 25, 0.6
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 16

CUT = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(CUT).split()


def stream(text: bytes) -> Iterator[bytes]:
    """The tokens of a text of any length, cut a piece at a time."""
    rest = b""
    for at in range(0, len(text), PIECE):
        piece = rest + text[at : at + PIECE].translate(CUT)
        # a word that reaches the end of the piece may go on in the next one
        cut = piece.rfind(b" ") + 1
        rest = piece[cut:]
        yield from piece[:cut].split()
    yield from rest.split()


@dataclass
class State:
    length: int
    link: int
    next: dict[int, int]
    #: (template, end) of one occurrence for each template that has the state's strings.
    at: dict[int, int]
    phrases: list[int]


class SuffixAutomaton:
    """Every run of words of every template, in one automaton."""

    def __init__(self, sequences: list[list[bytes]], phrases: list[list[bytes]]) -> None:
        self.ids: dict[bytes, int] = {}
        self.states = [State(0, -1, {}, {}, [])]
        for t, words in enumerate(sequences + phrases):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                self._visit(last, t, i)
        for p, words in enumerate(phrases):
            at = 0
            for w in words:
                at = self.states[at].next[self.ids[w]]
            self.states[at].phrases.append(p)
        self.sizes = [len(p) for p in phrases]
        # marks that a state reaches along its links
        self.marks: list[list[int]] = [[] for _ in self.states]
        for s in sorted(range(len(self.states)), key=lambda x: self.states[x].length):
            link = self.states[s].link
            self.marks[s] = self.states[s].phrases + (self.marks[link] if link >= 0 else [])

    def _visit(self, s: int, t: int, end: int) -> None:
        while s > 0 and t not in self.states[s].at:
            self.states[s].at[t] = end
            s = self.states[s].link

    def _extend(self, last: int, c: int) -> int:
        st = self.states
        if c in st[last].next:
            q = st[last].next[c]
            return q if st[last].length + 1 == st[q].length else self._clone(last, c, q)
        new = len(st)
        st.append(State(st[last].length + 1, 0, {}, {}, []))
        p = last
        while p >= 0 and c not in st[p].next:
            st[p].next[c] = new
            p = st[p].link
        if p >= 0:
            q = st[p].next[c]
            st[new].link = q if st[p].length + 1 == st[q].length else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        st = self.states
        new = len(st)
        st.append(State(st[p].length + 1, st[q].link, dict(st[q].next), dict(st[q].at), []))
        st[q].link = new
        while p >= 0 and st[p].next.get(c) == q:
            st[p].next[c] = new
            p = st[p].link
        return new

    def statistics(self, words: Iterable[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length of the longest match that ends there), where there is one."""
        st, get, s, length = self.states, self.ids.get, 0, 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                s = length = 0
                continue
            while s and c not in st[s].next:
                s = st[s].link
                length = st[s].length
            if c in st[s].next:
                s, length = st[s].next[c], length + 1
                yield i, s, length


@dataclass
class Span:
    template: int
    label: str
    start: int
    end: int
    covered: float


@dataclass
class Found:
    n_words: int
    #: (place, phrase) of each base phrase.
    base: list[tuple[int, int]]
    spans: list[Span]


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for _, label in phrases]
        self.sequences = [tokens(t.encode()) for _, t in templates]
        self.automaton = SuffixAutomaton(self.sequences, [tokens(p.encode()) for p, _ in phrases])

    def scan(self, text: bytes) -> Found:
        n_words = 0

        def counted() -> Iterator[bytes]:
            nonlocal n_words
            for w in stream(text):
                n_words += 1
                yield w

        auto, base, chains = self.automaton, [], Chains(self)
        before: tuple[int, int, int] | None = None
        for here in auto.statistics(counted()):
            i, s, length = here
            for p in auto.marks[s]:
                if auto.sizes[p] <= length:
                    base.append((i - auto.sizes[p] + 1, p))
            # a match is maximal if the next word does not lengthen it
            if before and before[2] >= MIN and not (i == before[0] + 1 and length == before[2] + 1):
                self._anchor(before, chains)
            before = here
        if before and before[2] >= MIN:
            self._anchor(before, chains)
        return Found(n_words, sorted(base), chains.spans())

    def _anchor(self, match: tuple[int, int, int], chains: Chains) -> None:
        """A maximal match as an anchor of each template that has it."""
        i, s, length = match
        for t, end in self.automaton.states[s].at.items():
            if t < len(self.labels):
                chains.add(t, i - length + 1, end - length + 1, length)


class Chains:
    """Anchors of a template in its order, with gaps of GAP at most: spans by the words that they cover.

    Anchors come in the order of where they end. Several chains of a template
    may be open, so that copies that stand inside each other are told apart; a
    chain that nothing can join any more is closed, so few are held.
    """

    def __init__(self, scanner: Scanner) -> None:
        self.scanner, self.closed = scanner, []
        #: template -> chains of start, end in the text, end in the template, words covered.
        self.open: dict[int, list[list[int]]] = {}

    def add(self, t: int, at: int, pos: int, n: int) -> None:
        here = self.open.setdefault(t, [])
        longest = len(self.scanner.sequences[t])
        for c in [c for c in here if at > c[1] + GAP + longest]:
            here.remove(c)
            self._close(t, c)
        fits = [c for c in here if pos + n > c[2] and pos + GAP >= c[2] >= pos - GAP and at <= c[1] + GAP and at + n > c[1]]
        if not fits:
            here.append([at, at + n, pos + n, n])
            return
        c = min(fits, key=lambda c: abs(pos - c[2]) + abs(at - c[1]))
        c[3] += n - max(0, c[2] - pos, c[1] - at)
        c[1], c[2] = at + n, pos + n

    def _close(self, t: int, c: list[int]) -> None:
        covered = c[3] / len(self.scanner.sequences[t])
        self.closed.append(Span(t, self.scanner.labels[t], c[0], c[1], min(1.0, covered)))

    def spans(self) -> list[Span]:
        for t, here in self.open.items():
            for c in here:
                self._close(t, c)
        self.open = {}
        return sorted(self.closed, key=lambda s: (s.start, s.template, s.end))


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,end:long,covered:double>>"


def _run(scanner_) -> Callable:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*scanner_.value)
        span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span)]
        names = [x.split()[0] for x in OUT.split(", ")]
        for batch in common.batches(rows):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), common.texts(batch.column(1))):
                f = scanner.scan(text)
                base = sorted({scanner.phrase_labels[p] for _, p in f.base})
                more = sorted({*base, *(s.label for s in f.spans if s.covered >= ENOUGH)})
                score = 1.0 if base else max((s.covered for s in f.spans), default=0.0)
                ends = (f.base[0][0], f.base[-1][0]) if f.base else (None, None)
                out.append((doc_id, f.n_words, len(f.base), *ends, ",".join(base), ",".join(more), score, [{"label": s.label, "start": s.start, "end": s.end, "covered": s.covered} for s in f.spans]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return run


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Base places, labels, score and spans of every row of docs(doc_id, text)."""
    spark = common.prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast((templates, phrases))  # a stated set of texts
    return common.pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_run(held), OUT)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir)).drop("spans")
