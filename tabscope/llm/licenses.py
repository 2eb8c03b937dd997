"""Licences by template markup compiled to token automata.

A template is a licence's wording with marked regions: ``[[ ... ]]`` may be missing, ``{{n}}`` stands for up to n words of any kind
(names, years, versions). It is compiled to a nondeterministic automaton over words: an arc per mandatory word, empty arcs around
optional regions, and arcs for any word in replaceable ones. A text has the template's label if the automaton accepts some run of
its words, that is if all mandatory wording stands there exactly, in order. Runs start at the template's first mandatory words, which
are looked up first, so that the automaton sees only places that can match.

Whole licences and notices are told apart. A whole licence (``LICENCES``) is accepted only with all its mandatory wording, from the
grant to the end of the disclaimer: with a condition left out or a word altered it gives no label. Names of holders, numbers of
clauses and passages that editions leave out are the regions that may vary. A notice (``NOTICES``) names a licence that stands elsewhere.

Besides, three phrases are looked up everywhere with labels of their own. Words are lower-cased (A-Z) runs of letters, digits and
all characters beyond ASCII, so typographic quotes are part of the words that they enclose.

``score`` is 1 for a text in which a template was accepted, 0.5 for one with phrases only, else 0.

Defined cases: a null text counts as empty: no words, no labels, no first or last word, score 0. Rows that repeat a doc_id are judged
each by its text. Texts are searched whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.common import by_value, slices

# Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Customary wording of licence notices, with regions that vary marked.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]",
    "mit": "released under the [[terms of the]] mit license",
    "gpl-3.0": "licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu [[lesser]] general public license as published by the free "
                  "software foundation either version {{3}} of the license or at your option any later version",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "cc-by-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by 4 0",
    "cc-by-sa-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by sa 4 0",
    "cc-by-nc-4.0": "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4 0",
    "copyright": "copyright [[c]] {{8}} all rights reserved",
}

# Wording of whole licences, in pieces that some of them share, with regions that vary marked.
_AS_IS = ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
          "merchantability fitness for a particular purpose and {{2}} in no event shall {{20}} be liable for any claim damages or other "
          "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
          "other dealings in the software")
_BSD_CONDITIONS = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
                   "conditions are met {{1}} redistributions of source code must retain the above copyright notice this list of conditions and "
                   "the following disclaimer {{1}} redistributions in binary form must reproduce the above copyright notice this list of "
                   "conditions and the following disclaimer in the documentation and or other materials provided with the distribution")
_BSD_NAMES = ("{{1}} neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this "
              "software without specific prior written permission")
_BSD_DISCLAIMER = ("this software is provided by {{20}} as is and any express or implied warranties including but not limited to the implied "
                   "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{20}} be liable for any "
                   "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of "
                   "substitute goods or services loss of use data or profits or business interruption however caused and on any theory of "
                   "liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use "
                   "of this software even if advised of the possibility of such damage")
LICENCES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
                "[[the software]] to deal in the software without restriction including without limitation the rights to use copy modify merge "
                "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do "
                "so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] "
                f"shall be included in all copies or substantial portions of the software {_AS_IS}",
    "bsd-2-clause": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "bsd-3-clause": f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_DISCLAIMER}",
    "isc": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that "
           "the above copyright notice and this permission notice appear in all copies the software is provided as is and {{20}} disclaims all "
           "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{20}} be "
           "liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
           "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of "
           "this software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will {{20}} be held liable for any damages "
            "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
            "applications and to alter it and redistribute it freely subject to the following restrictions {{1}} the origin of this software "
            "must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an "
            "acknowledgment in the product documentation would be appreciated but is not required {{1}} altered source versions must be plainly "
            "marked as such and must not be misrepresented as being the original software {{1}} this notice may not be removed or altered from "
            "any source distribution",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
                 "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by "
                 "any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright "
                 "interest in the software to the public domain we make this dedication for the benefit of the public at large and to the "
                 "detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all "
                 f"present and future rights to this software under copyright law {_AS_IS}",
}

TEMPLATES = NOTICES | LICENCES

_KEEP = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEEP).split()


class Template:
    """Automaton of one template; ``first`` are the mandatory words that it starts with."""

    def __init__(self, markup: str):
        self.arcs: list[dict[bytes, int]] = [{}]
        self.any: list[int] = [-1]
        self.empty: list[list[int]] = [[]]
        self.first = b""
        opened, leading, state = [], True, 0
        for piece in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", markup):
            if piece == "[[":
                opened.append(state)
                leading = False
            elif piece == "]]":
                end = self._state()  # a state of its own, so that what follows starts anew
                self.empty[state].append(end)
                self.empty[opened.pop()].append(end)
                state = end
            elif piece.startswith("{{"):
                leading, end, at = False, self._state(), state
                for _ in range(int(piece[2:-2])):
                    self.empty[at].append(end)
                    self.any[at] = at = self._state()
                self.empty[at].append(end)
                state = end
            else:
                word = piece.encode()
                if leading:
                    self.first += b" " + word
                self.arcs[state][word] = state = self._state()
        if not self.first or opened:
            raise ValueError("a template starts with a mandatory word and closes its optional regions")
        self.first += b" "
        self.final = state

    def _state(self) -> int:
        self.arcs.append({})
        self.any.append(-1)
        self.empty.append([])
        return len(self.arcs) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes], start: int) -> bool:
        """Whether a run of words from this one on is accepted."""
        states = self._closed({0})
        for at in range(start, len(words)):
            word = words[at]
            states = {s for old in states for s in (self.arcs[old].get(word, -1), self.any[old]) if s >= 0}
            if not states:
                return False
            if self.final in self._closed(states):
                return True
        return False


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which a phrase, with a space at either end, starts; overlapping ones too."""
    found, at, number, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        number += joined.count(b" ", seen, at)
        seen = at
        found.append(number)
        at = joined.find(phrase, at + 1)
    return found


class Scanner:
    def __init__(self, templates: Mapping[str, str], phrases: Mapping[str, str]):
        self.templates = {label: Template(markup) for label, markup in templates.items()}
        self.phrases = {b" " + p.encode() + b" ": label for p, label in phrases.items()}

    def __call__(self, text: str | None) -> tuple:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        base = {label: at for phrase, label in self.phrases.items() if (at := places(joined, phrase))}
        every = [n for at in base.values() for n in at]
        accepted = [label for label, t in self.templates.items()
                    if any(t.accepts(words, n) for n in places(joined, t.first))]
        return (len(words), len(every), min(every, default=None), max(every, default=None), sorted(base),
                sorted({*base, *accepted}), 1.0 if accepted else 0.5 if base else 0.0)


def scanned(docs: DataFrame, templates: Mapping[str, str] | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row; labels as sorted arrays."""
    wanted = dict(templates or TEMPLATES)
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(wanted, PHRASES)
        for batch in slices(batches, 1):
            columns = zip(*[scan(value) for value in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType)] + [T.StructField(n, T.LongType()) for n in names[:4]]
                          + [T.StructField(n, T.ArrayType(T.StringType())) for n in names[4:6]] + [T.StructField("score", T.DoubleType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


by_value(__name__)
