"""License scans: phrases, and templates with optional and replaceable regions.

A template's markup is compiled into an automaton over words: mandatory wording must
match word for word, ``[optional regions]`` may be left out, ``(a|b)`` is replaceable by
any of its wordings and ``{n}`` stands for up to n words of any kind; regions nest. An
automaton is started only where a template's first words stand and is run over the words
that follow, so a text without them costs one vectorised pass. Whole licenses are
templates of their own beside their opening words, so a text that alters a later clause
has the opening's label alone.

Words are stretches of non-ASCII characters and ASCII digits and letters, with A-Z in
lower case. Cases: null is the empty text, which has no words, no labels and score
0.0; repeated rows are scanned each; a null id stays null; very long texts are scanned
whole; repeated labels count once; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import text

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses as template markup by label. [..] is optional, (a|b) is one of several wordings
# and {n} stands for up to n words of any kind; regions nest. Labels in -opening are of a license's first words alone.
_AS_IS = "(as is|“as is”|‘as is’)"
_LIABLE = "for any claim damages or other liability whether in an action of contract tort or otherwise arising"
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the (software|“software”) to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_TWO = f"{_BSD} [(1|a)] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [(2|b)] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_END = f"this software is provided by {{12}} {_AS_IS} and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_GPL = "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
_GPL_END = "(this program|{6}) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details [you should have received a copy of the gnu general public license along with {4} [if not (see [http|https] www gnu org licenses|write to the free software foundation [inc {16}])]]"
TEMPLATES = {
    "mit-text": f"{_MIT} [and] to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software the software is provided {_AS_IS} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and (noninfringement|non infringement) in no event shall (the authors or copyright holders|{{12}}) be liable {_LIABLE} from out of or in connection with the software or the use or other dealings in the software",
    "mit-opening": f"{_MIT} [and to permit persons to whom the software is furnished to do so] subject to the following conditions",
    "mit-notice": "released under [the terms of] the mit license",
    "isc-text": f"permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided {_AS_IS} and {{8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause-text": f"{_BSD_TWO} {_BSD_END}",
    "bsd-3-clause-text": f"{_BSD_TWO} [(3|c)] neither the (name|names) of {{16}} nor the names of [its] {{6}} may be used to endorse or promote products derived from this software without specific prior written permission {_BSD_END}",
    "bsd-opening": _BSD,
    "zlib-text": "this software is provided (as is|‘as is’|‘as-is’) without any express or implied warranty in no event will (the [author|authors]|{8}) be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [1] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [2] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [3] this notice may not be removed or altered from any source distribution",
    "unlicense-text": f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law [the software is provided {_AS_IS} without warranty of any kind {{80}}]",
    "apache-2.0-text-notice": f"licensed under the apache license version 2 0 [the (license|“license”)] you may not use this file except in compliance with the license you may obtain a copy of the license at {{10}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an {_AS_IS} basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-header": "licensed under the apache license version 2 0 {4} you may not use this file except in compliance with the license [you may obtain a copy of the license at {12}]",
    "apache-2.0-notice": "licensed under the apache license [version] 2 0",
    "gpl-2.0-text-notice": f"{_GPL} (either version 2 of the license or at your option any later version|version 2 of the license) {_GPL_END}",
    "gpl-3.0-text-notice": f"{_GPL} (either version 3 of the license or at your option any later version|version 3 of the license) {_GPL_END}",
    "gpl-header": "this program is free software [[you can] redistribute it] and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-3.0-notice": "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3",
    "gpl-2.0-notice": "licensed under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2",
    "cc-notice": "licensed under [a|the] creative commons attribution [noncommercial] [share alike|sharealike] {2} [license]",
}


@dataclass(frozen=True)
class Automaton:
    """States 0..n; edges[s] are (word or None for any, next state), skips[s] are moves without a word."""

    label: str
    edges: tuple[tuple[tuple[bytes | None, int], ...], ...]
    skips: tuple[tuple[int, ...], ...]
    head: tuple[bytes, ...]

    def closure(self, states: set[int]) -> set[int]:
        out, stack = set(states), list(states)
        while stack:
            for t in self.skips[stack.pop()]:
                if t not in out:
                    out.add(t)
                    stack.append(t)
        return out

    def longest(self, words: list[bytes]) -> int:
        """Words of the longest prefix that the template accepts; 0 where it accepts none."""
        states, end, accept = self.closure({0}), 0, len(self.edges) - 1
        for k, w in enumerate(words):
            states = self.closure({t for s in states for want, t in self.edges[s] if want is None or want == w})
            if not states:
                break
            if accept in states:
                end = k + 1
        return end

    @property
    def limit(self) -> int:
        return sum(map(len, self.edges))


def compile_template(label: str, markup: str) -> Automaton:
    """Regions nest; the template begins with at least one mandatory word."""
    edges: list[list[tuple[bytes | None, int]]] = [[]]
    skips: list[list[int]] = [[]]
    head: list[bytes] = []
    plain = True
    regions: list[tuple[str, int, list[int]]] = []  # kind, state before, ends of the wordings so far

    def state() -> int:
        edges.append([])
        skips.append([])
        return len(edges) - 1

    def step(word: bytes | None) -> None:
        here = len(edges) - 1
        edges[here].append((word, state()))

    for token in re.findall(r"[\[\]()|]|\{\d+\}|[^\s\[\]{}()|]+", markup):
        if token in "[(":
            plain = False
            regions.append((token, len(edges) - 1, []))
            skips[-1].append(state())  # a wording begins in a state of its own
        elif token == "|":
            regions[-1][2].append(len(edges) - 1)
            skips[regions[-1][1]].append(state())
        elif token in "])":
            kind, before, ends = regions.pop()
            if "[(".index(kind) != "])".index(token):
                raise ValueError(f"{label}: {kind} is closed by {token}")
            last = len(edges) - 1
            after = state()
            for s in [*ends, last, *([before] if kind == "[" else [])]:
                skips[s].append(after)
        elif token[0] == "{":
            plain, begin = False, len(edges) - 1
            for _ in range(int(token[1:-1])):
                step(None)
            for s in range(begin, len(edges) - 1):
                skips[s].append(len(edges) - 1)
        else:
            step(token.lower().encode())
            if plain:
                head.append(token.lower().encode())
    if not head or regions:
        raise ValueError(f"{label}: a template begins with a mandatory word and closes its regions")
    return Automaton(label, tuple(map(tuple, edges)), tuple(map(tuple, skips)), tuple(head[:3]))


def _hash_of(word: bytes) -> np.uint64:
    return text.Words(np.frombuffer(word, np.uint8), np.array([0, len(word)]), separators=text.NOT_ALNUM).hash[0]


def _stands(h: np.ndarray, doc: np.ndarray, wanted: list[np.uint64]) -> np.ndarray:
    """Places where the words stand one after another in one document."""
    m = len(wanted)
    if len(h) < m:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[: len(h) - m + 1] == wanted[0])
    for j in range(1, m):
        at = at[h[at + j] == wanted[j]]
    return at[doc[at] == doc[at + m - 1]]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])))])


def _scanner(phrases: dict[str, str], templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(label, [_hash_of(w.encode()) for w in phrase.split()]) for phrase, label in phrases.items()]
        automata = [compile_template(*x) for x in templates.items()]
        heads = [(a, [_hash_of(w) for w in a.head]) for a in automata]
        for batch in batches:
            ids = batch.column("doc_id")
            for first, last, data, offsets in text.string_slices(batch.column("text")):
                words = text.Words(data, offsets, separators=text.NOT_ALNUM)
                base: dict[int, list[tuple[int, str, int]]] = {}
                more: dict[int, list[tuple[int, str, int]]] = {}
                for label, hashes in wanted:
                    for at in _stands(words.hash, words.doc, hashes).tolist():
                        doc = int(words.doc[at])
                        base.setdefault(doc, []).append((at - int(words.first[doc]), label, len(hashes)))
                for a, hashes in heads:
                    for at in _stands(words.hash, words.doc, hashes).tolist():
                        doc = int(words.doc[at])
                        own = slice(at, min(at + a.limit, int(words.first[doc + 1])))
                        said = [words.data[s:e].tobytes() for s, e in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)]
                        if n := a.longest(said):
                            more.setdefault(doc, []).append((at - int(words.first[doc]), a.label, n))
                rows = []
                for k in range(last - first):
                    b, found = base.get(k, []), base.get(k, []) + more.get(k, [])
                    covered = set().union(*(range(s, s + n) for s, _, n in found)) if found else ()
                    rows.append({
                        "doc_id": ids[first + k].as_py(), "n_words": int(words.count[k]), "n_base": len(b),
                        "first_word": min((s for s, *_ in b), default=None), "last_word": max((s for s, *_ in b), default=None),
                        "base_labels": ",".join(sorted({x for _, x, _ in b})), "labels": ",".join(sorted({x for _, x, _ in found})),
                        "score": len(covered) / int(words.count[k]) if found else 0.0,
                        "matches": [{"label": x, "start": s, "words": n} for s, x, n in sorted(found)],
                    })
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return run


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: word count, phrase places, labels of phrases and templates, the matches' spans in words,
    and as score the part of the words that matches cover."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label string, start long, words long>>"
    return own.mapInArrow(_scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates), schema)
