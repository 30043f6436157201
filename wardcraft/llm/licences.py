"""License scans by template markup.

A template is license wording with marked regions: <<optional>> ... <</optional>> may be absent, and <<var NAME
PATTERN MOST>> stands for 1 to MOST words (* for any number) that each match PATTERN in full. It is compiled to a token automaton:
states, edges that read a word, and free edges. A text is accepted where the automaton reads words from one
place on to its final state, so all mandatory wording has to be there exactly and in order: full texts run from the grant to
the end of the disclaimer, and one with a changed condition isn't accepted. Automata start only where a template's first two words stand, and
each passes over a text once, whatever number of openings it has. A copyright line's holder has up to 40 words.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.text import as_batch, per_batch, table, table_of, texts

_WORD = table_of("abcdefghijklmnopqrstuvwxyz0123456789")
_WORD[128:] = True
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Base phrases and their labels. Fixed values.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_BSD = "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<optional>> 1 <</optional>> redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<optional>> 2 <</optional>> redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "this software is provided by <<var holder (?!as$).+ *>> 'as is' and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall <<var holder (?!be$).+ *>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
#: Templates by label. The wording of well-known public license texts and notices.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 <<optional>> the license you may not use this file except in compliance with the license <</optional>>",
    "apache-2.0-header": "licensed under the apache license, version 2.0 (the 'license'); you may not use this file except in compliance with the license. you may obtain a copy of the license at <<var scheme https? 1>> www.apache.org/licenses/license-2.0 unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an 'as is' basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.",
    "apache": "licensed under the apache license version <<var version [0-9]+ 3>>",
    "gpl-notice": "licensed under the gnu general public license <<optional>> as published by the free software foundation <</optional>> <<optional>> either <</optional>> version <<var version [0-9]+ 2>> <<optional>> or at your option any later version <</optional>>",
    "gpl-header": "this <<var what program|library|software|file|package 1>> is free software you can redistribute it and/or modify it under the terms of the gnu <<optional>> lesser <</optional>> <<optional>> affero <</optional>> general public license as published by the free software foundation either version <<var version [0-9]+ 2>> of the license, or (at your option) any later version. this <<var what program|library|software|file|package 1>> is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu <<optional>> lesser <</optional>> <<optional>> affero <</optional>> general public license for more details.",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at <<var scheme https? 1>> mozilla.org/mpl/2.0",
    "cc-notice": "licensed under <<optional>> a <</optional>> <<optional>> creative commons attribution <<optional>> license <</optional>> <</optional>> cc by <<var terms nc|nd|sa 2>> <<var version [0-9]+ 2>>",
    "cc-by-notice": "licensed under <<optional>> a <</optional>> <<optional>> creative commons attribution <<optional>> license <</optional>> <</optional>> cc by <<var version [0-9]+ 2>>",
    "mit": "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'software'), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission notice <<optional>> (including the next paragraph) <</optional>> shall be included in all copies or substantial portions of the software. the software is provided 'as is', without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall <<var holder (?!be$).+ *>> be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "mit-notice": "under the mit license",
    "isc": "permission to use, copy, modify, and <<optional>> or <</optional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is provided 'as is' and <<var author (?!disclaims?$).+ *>> <<var verb disclaims? 1>> all warranties with regard to this software including all implied warranties of merchantability and fitness. in no event shall <<var author (?!be$).+ *>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
    "zlib": "this software is provided 'as-is', without any express or implied warranty. in no event will <<var authors (?!be$).+ *>> be held liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<optional>> 1 <</optional>> the origin of this software must not be misrepresented; you must not claim that you wrote the original software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<optional>> 2 <</optional>> altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<optional>> 3 <</optional>> this notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the 'software') to use, reproduce, display, distribute, execute, and transmit the software, and to prepare derivative works of the software, and to permit third-parties to whom the software is furnished to do so, all subject to the following: the copyright notices in the software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the software, in whole or in part, and all derivative works of the software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. the software is provided 'as is', without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose, title and non-infringement. in no event shall <<var holder (?!be$).+ *>> be liable for any damages or other liability, whether in contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    "unlicense": "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-2-clause": f"{_BSD} {_BSD_END}",
    "bsd-3-clause": f"{_BSD} <<optional>> 3 <</optional>> neither the name of <<var holder (?!nor$).+ *>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}",
    "copyright": "copyright <<optional>> c <</optional>> <<var years [0-9]{4} 2>> <<var holder (?!copyright$).+ 40>> all rights reserved",
}
_MARK = re.compile(r"<<(/?)(\w+)([^<>]*)>>|([^\s<>]+)")


#: A text without any of these has no template: each is the first or, where that is common, a later word of some. Held by a test.
_MUST = (b"license", b"licensed", b"permission", b"redistribution", b"copyright", b"unencumbered")


LONG = 9


class Automaton:
    """States by number; 0 is the first. words: state -> (word -> state); tests: state -> [(pattern, state)]; free: state -> [state]."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]
        self.tests: list[list[tuple[re.Pattern, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        at, open_ = 0, []
        #: With a region of any number of words, or of more than LONG, the shortest reading counts, else the longest.
        self.shortest = False
        for close, kind, rest, word in _MARK.findall(template):
            if word:
                for w in WORD.findall(word.encode()):
                    to = self._state()
                    self.words[at][w] = to
                    at = to
            elif kind == "optional" and not close:
                open_.append(at)
                to = self._state()
                self.free[at].append(to)
                at = to
            elif kind == "optional":
                to = self._state()
                self.free[at].append(to)
                self.free[open_.pop()].append(to)
                at = to
            elif kind == "var":
                _, pattern, most = rest.rsplit(None, 2)[-3:] if len(rest.split()) > 2 else ("", *rest.split())
                end, test = self._state(), re.compile(pattern.encode())
                self.shortest |= most == "*" or int(most) > LONG
                if most == "*":
                    to = self._state()
                    self.tests[at].append((test, to))
                    self.tests[to].append((test, to))
                    self.free[to].append(end)
                for _k in range(int(most) if most != "*" else 0):
                    to = self._state()
                    self.tests[at].append((test, to))
                    self.free[to].append(end)
                    at = to
                at = end
            else:
                raise ValueError(f"unknown mark {kind}")
        if open_:
            raise ValueError("an optional region is not closed")
        self.final = at
        self.begin = self._closed({0})
        self.first = frozenset().union(*[self.words[s].keys() for s in self._closed({0})])
        if any(self.tests[s] for s in self._closed({0})) or not self.first:
            raise ValueError("a template starts with a word")

    def _state(self) -> int:
        self.words.append({})
        self.tests.append([])
        self.free.append([])
        return len(self.words) - 1

    def _closed(self, states: set[int]) -> set[int]:
        work = list(states)
        while work:
            for to in self.free[work.pop()]:
                if to not in states:
                    states.add(to)
                    work.append(to)
        return states

    def openings(self) -> set[tuple[bytes, bytes | None]]:
        """The first two words that a reading can have; None: not one certain word."""
        out: set[tuple[bytes, bytes | None]] = set()
        for s in self._closed({0}):
            for first, to in self.words[s].items():
                for t in self._closed({to}):
                    out.update((first, second) for second in self.words[t])
                    if self.tests[t] or t == self.final:
                        out.add((first, None))
        return out

    def matches(self, words: list[bytes], starts: list[int]) -> list[tuple[int, int]]:
        """(start, one past the last word) of the readings that begin at the places `starts`, in order, in one pass over the words.

        Of readings that stand in one state only the earliest is followed, as all go on alike: what is accepted for any of them is accepted for it.
        """
        out: dict[int, int] = {}
        states: dict[int, int] = {}  # with the start of the reading
        k = i = 0
        while states or i < len(starts):
            k = k if states else starts[i]
            if k >= len(words):
                break
            w, new = words[k], {}
            now = list(states.items())
            if i < len(starts) and starts[i] == k:
                now += [(s, k) for s in self.begin]
                i += 1
            for s, start in now:
                for to in [self.words[s][w]] if w in self.words[s] else []:
                    new[to] = min(new.get(to, start), start)
                for test, to in self.tests[s]:
                    if start < new.get(to, len(words)) and test.fullmatch(w):
                        new[to] = start
            work = list(new)
            while work:
                s = work.pop()
                for to in self.free[s]:
                    if new[s] < new.get(to, len(words)):
                        new[to] = new[s]
                        work.append(to)
            if self.final in new:
                start = new[self.final]
                out[start] = k + 1
                if self.shortest:
                    new = {s: x for s, x in new.items() if x != start}
            states = new
            k += 1
        return sorted(out.items())


@cache
def _compiled() -> tuple[dict[str, Automaton], re.Pattern, re.Pattern]:
    automata = {k: Automaton(v) for k, v in TEMPLATES.items()}
    # two words with no word byte before or after, so that common first words cost nothing
    by: dict[bytes, set[bytes | None]] = {}
    for first, second in sorted(set().union(*[x.openings() for x in automata.values()]), key=str):
        by.setdefault(first, set()).add(second)
    pairs = [first if None in more else first + rb"[^a-z0-9\x80-\xff]+(?:" + b"|".join(sorted(more)) + b")" for first, more in by.items()]
    anchor = re.compile(rb"(?<![a-z0-9\x80-\xff])(?=(?:" + b"|".join(pairs) + rb")(?![a-z0-9\x80-\xff]))")
    phrase = re.compile(b"|".join(rb"(?<![a-z0-9\x80-\xff])(" + rb"[^a-z0-9\x80-\xff]+".join(p.encode().split()) + rb")(?![a-z0-9\x80-\xff])" for p in PHRASES))
    return automata, anchor, phrase


def scan(text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str]]]:
    """(words, base places (first word, label), accepted templates (first word, one past the last, label)) of a text in UTF-8."""
    low = text.lower()  # A-Z only
    word = _WORD[np.frombuffer(low, np.uint8)]
    start = word & ~np.r_[False, word[:-1]] if len(word) else word
    n = int(np.count_nonzero(start))
    automata, anchor, phrase = _compiled()
    base, found, number = [], [], None
    labels = list(PHRASES.values())
    for m in phrase.finditer(low):
        number = np.cumsum(start) if number is None else number
        base.append((int(number[m.start()]) - 1, labels[m.lastindex - 1]))
    words: list[bytes] = []
    if any(x in low for x in _MUST):
        spots = [m.start() for m in anchor.finditer(low)]
        if spots:
            number = np.cumsum(start) if number is None else number
            words, places = WORD.findall(low), [int(k) - 1 for k in number[spots]]
        for label, automaton in automata.items() if spots else ():
            found += [(a, b, label) for a, b in automaton.matches(words, [at for at in places if words[at] in automaton.first])]
        found.sort()
    return n, base, found


def covered(n: int, base: list[tuple[int, str]], found: list[tuple[int, int, str]]) -> float:
    """The share of words that lie in a base place or an accepted template."""
    size = {v: len(k.split()) for k, v in PHRASES.items()}
    spans, total, upto = sorted([(a, a + size[label]) for a, label in base] + [(a, b) for a, b, _ in found]), 0, 0
    for a, b in spans:
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total / n if n else 0.0


def scan_documents(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_words, base array of (word, label), templates array of (start, end, label), score.

    One row per row; a null text counts as empty: no words, no places, score 0. A null doc_id is kept, repeated rows are repeated, other columns are ignored.
    """
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])), pa.float64()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(x) for x in texts(batch)]
        base = [[{"word": a, "label": x} for a, x in r[1]] for r in rows]
        found = [[{"start": a, "end": b, "label": x} for a, b, x in r[2]] for r in rows]
        return as_batch(["doc_id", "n_words", "base", "templates", "score"], kinds, [batch.column("doc_id"), [r[0] for r in rows], base, found, [covered(*r) for r in rows]])

    schema = "doc_id long, n_words long, base array<struct<word long, label string>>, templates array<struct<start long, end long, label string>>, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_batch(run), schema)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"))
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.col(x)["label"] for x in c]))), ",")
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base")["word"]).alias("first_word"), F.array_max(F.col("base")["word"]).alias("last_word"), labels("base").alias("base_labels"), labels("base", "templates").alias("labels"), "score")
