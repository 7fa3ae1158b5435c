"""License scans: template markup compiled into token automata.

A template is a line of words with optional regions ``[[...]]`` and replaceable regions ``<<a-b>>`` (a to b words of any kind). It
becomes an automaton over words; a place in a text matches if the mandatory words stand there exactly and in order. A text goes
through an automaton only if it has the template's longest run of mandatory words, and from the places of its possible first words.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: the base phrases and their labels
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# fixed values: whole mandatory wording of well-known licences and notices, as words
_GRANT = ("permission is hereby granted free of charge to any person obtaining a copy of <<1-8>> and associated documentation files [[the software]] to deal in the software "
          "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
          "persons to whom the software is furnished to do so")
_AS_IS = ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
          "purpose and noninfringement in no event shall <<1-10>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from "
          "out of or in connection with the software or the use or other dealings in the software")
_FORMS = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source "
          "code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright "
          "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution")
_DISCLAIMED = ("this software is provided by <<1-10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for "
               "a particular purpose are disclaimed in no event shall <<1-10>> be liable for any direct indirect incidental special exemplary or consequential damages including but "
               "not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether "
               "in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage")
_FREE = ("is free software you can redistribute it and or modify it under the terms of the gnu {0} public license as published by the free software foundation [[either]] version {1} "
         "[[of the license]] [[or at your option any later version]] <<1-4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty "
         "of merchantability or fitness for a particular purpose see the gnu {0} public license for more details")
TEMPLATES = (
    ("mit", f"{_GRANT} subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or "
            f"substantial portions of the software {_AS_IS}"),
    ("mit-0", f"{_GRANT} {_AS_IS}"),
    ("isc", "permission to use copy modify [[and]] [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
            "permission notice appear in all copies the software is provided as is and <<1-6>> disclaims all warranties with regard to this software including all implied warranties of "
            "merchantability and fitness in no event shall <<1-6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use "
            "data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("bsd-2", f"{_FORMS} {_DISCLAIMED}"),
    ("bsd-3", f"{_FORMS} [[3]] neither the name of <<1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
              f"written permission {_DISCLAIMED}"),
    ("apache-2", "licensed under the apache license version 2 0 [[the license]] you may not use this <<1-4>> except in compliance with the license [[you may obtain a copy of the license at "
                 "<<1-12>>]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions "
                 "of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-2", _FREE.format("general", 2)),
    ("gpl-3", _FREE.format("general", 3)),
    ("lgpl-2-1", _FREE.format("lesser general", "2 1")),
    ("lgpl-3", _FREE.format("lesser general", 3)),
    ("agpl-3", _FREE.format("affero general", 3)),
    ("all-rights-reserved", "copyright [[c]] <<1-8>> all rights reserved"),
    ("all-rights-reserved", "all rights reserved"),
    ("public-domain", "released into the public domain"),
    # names of licences: labels of their own kind, as a name grants nothing
    ("name:gpl-2", "gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("name:gpl-3", "gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("name:lgpl", "gnu lesser general public license [[as published by the free software foundation]] [[either]] [[version <<1-1>>]]"),
    ("name:agpl", "gnu affero general public license [[as published by the free software foundation]] [[either]] [[version <<1-1>>]]"),
    ("name:mpl-2", "mozilla public license [[v]] [[version]] 2 [[0]]"),
    ("name:bsd", "under the [[terms of the]] [[2 clause]] [[3 clause]] [[new]] [[simplified]] [[modified]] bsd [[2 clause]] [[3 clause]] license"),
    ("name:cc-by-nc", "creative commons attribution noncommercial [[sharealike]] [[noderivatives]] [[<<1-1>> 0]] [[international]] license"),
    ("name:cc-by-sa", "cc by sa"),
    ("name:cc-by-sa", "creative commons attribution sharealike [[<<1-1>> 0]] [[international]] license"),
    ("name:cc-by", "creative commons attribution [[<<1-1>> 0]] [[international]] license"),
    ("name:cc-by", "licensed under cc by [[<<1-1>>]] 0"),
    ("name:cc0", "creative commons cc0 [[1 0]] [[universal]]"),
)

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only): runs of ASCII letters and digits and of anything outside ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Span(NamedTuple):
    label: str
    start: int
    end: int
    base: bool


class Automaton:
    """States are places in the template; ``steps[s]`` has (word or None for any word, next state), ``free[s]`` states reached without a word."""

    def __init__(self, label: str, template: str, base: bool = False):
        self.label, self.base = label, base
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        runs, run, opened = [], [], []
        for part in re.findall(r"\[\[|\]\]|<<\d+-\d+>>|[^\s\[\]<>]+", template):
            here = len(self.steps) - 1
            if part == "[[":
                opened.append(here)
            elif part == "]]":
                self.free[opened.pop()].append(here)
            elif part.startswith("<<"):
                low, high = map(int, part[2:-2].split("-"))
                for k in range(high):
                    self._grow(None)
                for k in range(low, high):
                    self.free[here + k].append(here + high)
            else:
                self._grow(part.encode())
            if part[0] in "[<]" or opened:
                runs, run = [*runs, run], []
            else:
                run.append(part.encode())
        self.final = len(self.steps) - 1
        self.anchor = b" " + b" ".join(max([*runs, run], key=lambda r: len(b" ".join(r)))) + b" "
        self.first = {w for s in self._reach({0}) for w, _ in self.steps[s]}

    def _grow(self, word: bytes | None) -> None:
        self.steps.append([])
        self.free.append([])
        self.steps[-2].append((word, len(self.steps) - 1))

    def _reach(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, ws: list[bytes], start: int) -> int | None:
        """The end of the longest match that starts here."""
        states, end = self._reach({0}), None
        for k in range(start, len(ws) + 1):
            if self.final in states:
                end = k
            if k == len(ws):
                break
            states = self._reach({t for s in states for w, t in self.steps[s] if w is None or w == ws[k]})
            if not states:
                break
        return end

    def spans(self, ws: list[bytes], joined: bytes) -> list[Span]:
        if self.anchor not in joined:
            return []
        out: list[Span] = []
        for k, w in enumerate(ws):
            if w in self.first and (end := self.match(ws, k)) is not None:
                if self.base or not out or end > out[-1].end:  # a later start of the same wording adds nothing
                    out.append(Span(self.label, k, end, self.base))
        return out


def automata() -> list[Automaton]:
    return [Automaton(label, t, True) for label, t in BASE] + [Automaton(label, t) for label, t in TEMPLATES]


def scan(text: str | None, nets: list[Automaton]) -> tuple[int, list[Span], int]:
    """Number of words, all matches, and the number of words that some match covers."""
    ws = words(text)
    joined = b" " + b" ".join(ws) + b" "
    spans = sorted((s for net in nets for s in net.spans(ws, joined)), key=lambda s: (s.start, s.end, s.label))
    covered, upto = 0, 0
    for s in spans:
        covered += max(s.end - max(s.start, upto), 0)
        upto = max(upto, s.end)
    return len(ws), spans, covered


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def _scan_batches(batches):
    nets = automata()
    for b in batches:
        keep = [k for k, n in enumerate(b.schema.names) if n != "text"]
        for start in range(0, b.num_rows, 512):  # bounds what is held as Python objects
            s = b.slice(start, 512)
            found = [scan(t, nets) for t in s.column(b.schema.names.index("text")).to_pylist()]
            new = [pa.array([f[0] for f in found], pa.int64()), pa.array([[x._asdict() for x in f[1]] for f in found], pa.list_(_SPAN)), pa.array([f[2] for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([s.column(k) for k in keep] + new, names=[b.schema.names[k] for k in keep] + ["n_words", "spans", "n_covered"])


def scan_licenses(docs: DataFrame, *carry: str) -> DataFrame:
    """The columns ``carry`` with ``n_words``, ``spans`` (label, start, end, base; in word positions) and ``n_covered`` of every whole text.

    NULL and empty texts have no words and no spans. Every row comes out once, repeated rows too; other columns are not read.
    """
    rows = docs.select(*carry, "text")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_scan_batches, schema + "n_words bigint, spans array<struct<label: string, `start`: bigint, `end`: bigint, base: boolean>>, n_covered bigint")
