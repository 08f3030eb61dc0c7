"""Licence statements in whole texts through a generalised suffix automaton of licence tokens.

Files stream through the automaton of all templates; at each word it gives the
longest run of words ending there that some template has (the matching
statistics). Long maximal runs are chained in the order of their template into
spans, and a template that is covered well enough, its version with it, gives
its label. Of spans that lie over each other the best covered one counts.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import extended, others, quoted

#: Phrases that always give their label.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Parts of public licence texts and of the usual statements, by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
     documentation files the software to deal in the software without restriction including without limitation the rights to
     use copy modify merge publish distribute sublicense and or sell copies of the software"""),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", """you may not use this file except in compliance with the license you may obtain a copy of the license at
     http www apache org licenses license 2 0"""),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", """this program is free software you can redistribute it and or modify it under the terms of the gnu general
     public license as published by the free software foundation either version 3 of the license or at your option any later
     version"""),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-2", """this program is free software you can redistribute it and or modify it under the terms of the gnu general
     public license as published by the free software foundation either version 2 of the license or at your option any later
     version"""),
    ("gpl-2", """this program is free software you can redistribute it and or modify it under the terms of the gnu general
     public license version 2 as published by the free software foundation"""),
    ("lgpl-2", """this library is free software you can redistribute it and or modify it under the terms of the gnu library
     general public license as published by the free software foundation either version 2 of the license or at your option any
     later version"""),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-2.1", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser
     general public license as published by the free software foundation either version 2 1 of the license or at your option
     any later version"""),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("lgpl-3", """this program is free software you can redistribute it and or modify it under the terms of the gnu lesser
     general public license as published by the free software foundation either version 3 of the license or at your option any
     later version"""),
    ("agpl-3", """this program is free software you can redistribute it and or modify it under the terms of the gnu affero
     general public license as published by the free software foundation either version 3 of the license or at your option any
     later version"""),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the
     following conditions are met"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
     granted provided that the above copyright notice and this permission notice appear in all copies"""),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
     documentation files the software to deal in the software without restriction including without limitation the rights to
     use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
     software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
     shall be included in all copies or substantial portions of the software the software is provided as is without warranty of
     any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
     purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
     liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
     the use or other dealings in the software"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
     granted provided that the above copyright notice and this permission notice appear in all copies the software is provided
     as is and the author disclaims all warranties with regard to this software including all implied warranties of
     merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential
     damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence
     or other tortious action arising out of or in connection with the use or performance of this software"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the
     following conditions are met 1 redistributions of source code must retain the above copyright notice this list of
     conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this
     list of conditions and the following disclaimer in the documentation and or other materials provided with the
     distribution this software is provided by the copyright holders and contributors as is and any express or implied
     warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose
     are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
     special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss
     of use data or profits or business interruption however caused and on any theory of liability whether in contract strict
     liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
     the possibility of such damage"""),
    ("bsd-3", """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
     products derived from this software without specific prior written permission"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held
     liable for any damages arising from the use of this software permission is granted to anyone to use this software for any
     purpose including commercial applications and to alter it and redistribute it freely subject to the following
     restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original
     software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is
     not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original
     software 3 this notice may not be removed or altered from any source distribution"""),
    ("bsl-1", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
     accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit
     the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished
     to do so all subject to the following"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify
     publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose
     commercial or non commercial and by any means"""),
    ("apache-2", """unless required by applicable law or agreed to in writing software distributed under the license is
     distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for
     the specific language governing permissions and limitations under the license"""),
    ("mpl-2", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
     distributed with this file you can obtain one at http mozilla org mpl 2 0"""),
    ("wtfpl", "do what the fuck you want to public license"),
    ("cc0", "creative commons zero v1 0 universal"),
]

#: Words of the shortest run that is chained, words that may lie between two runs of a chain, and share of a template that must be covered.
MIN_RUN, MAX_GAP, COVER = 5, 8, 0.85
#: Bytes to themselves if they make words, A-Z to a-z, all else to a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


class SuffixAutomaton:
    """Generalised suffix automaton of several token sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]  # sequence -> least end of an occurrence

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _clone(self, source: int, edge: int, token: int) -> int:
        target = self.next[source][token]
        copy = self._state(self.length[source] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while edge >= 0 and self.next[edge].get(token) == target:
            self.next[edge][token] = copy
            edge = self.link[edge]
        return copy

    def add(self, sequence: int, tokens: list[int]) -> None:
        last = 0
        for end, token in enumerate(tokens, 1):
            known = self.next[last].get(token)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._clone(last, last, token)
            else:
                state = self._state(self.length[last] + 1, 0, {})
                edge = last
                while edge >= 0 and token not in self.next[edge]:
                    self.next[edge][token] = state
                    edge = self.link[edge]
                if edge >= 0:
                    target = self.next[edge][token]
                    self.link[state] = target if self.length[target] == self.length[edge] + 1 else self._clone(edge, edge, token)
                last = state
            self.ends[last].setdefault(sequence, end)

    def finish(self) -> None:
        """Give each state the ends of all the longer ones that it is a suffix of."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[state]]
            for sequence, end in self.ends[state].items():
                up[sequence] = min(end, up.get(sequence, end))

    def statistics(self, tokens: list[int]):
        """(state, length) of the longest run of any sequence that ends at each token."""
        state = size = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state = self.next[state][token]
                size += 1
            yield state, size


class Scanner:
    """Scans word lists for base phrases and template spans."""

    def __init__(self, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None):
        phrases = BASE_PHRASES if phrases is None else phrases
        templates = TEMPLATES if templates is None else templates
        sequences = [p.split() for p in (*phrases, *(t for _, t in templates))]
        self.vocabulary = {word: k for k, word in enumerate(dict.fromkeys(w.encode() for s in sequences for w in s))}
        self.labels = [*phrases.values(), *(label for label, _ in templates)]
        self.sizes, self.n_phrases = [len(s) for s in sequences], len(phrases)
        self.versions = [{k for k, w in enumerate(s) if w.isdigit() and not (w == "0" and s[k - 1].isdigit())} for s in sequences]
        self.automaton = SuffixAutomaton()
        for k, words in enumerate(sequences):
            self.automaton.add(k, [self.vocabulary[w.encode()] for w in words])
        self.automaton.finish()
        self.whole = [self._phrases_at(state) for state in range(len(self.automaton.next))]
        self.shortest = min([MIN_RUN, *self.sizes])

    def _phrases_at(self, state: int) -> list[int]:
        """The phrases that end wherever this state is reached by its longest run, or by a shorter one."""
        found = []
        while state > 0:
            found += [k for k, end in self.automaton.ends[state].items() if k < self.n_phrases and end == self.sizes[k] <= self.automaton.length[state]]
            state = self.automaton.link[state]
        return sorted(set(found))

    def scan(self, text: str | None):
        """(n_words, base places [(start, label)], spans [(label, first, last, covered)]) of a text."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        base, runs = [], []
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if hi - lo >= self.shortest:
                self._run(ids[lo:hi].tolist(), lo, base, runs)
        return len(words), sorted(base), self._chain(runs)

    def _run(self, tokens: list[int], at: int, base: list, runs: list) -> None:
        before = (0, 0)
        for k, (state, size) in enumerate(self.automaton.statistics(tokens)):
            for phrase in self.whole[state]:
                if self.sizes[phrase] <= size:
                    base.append((at + k + 1 - self.sizes[phrase], self.labels[phrase]))
            if size <= before[1] and before[1] >= MIN_RUN:
                runs.append((at + k, *before))
            before = state, size
        if before[1] >= MIN_RUN:
            runs.append((at + len(tokens), *before))

    def _chain(self, runs: list) -> list:
        """Covered spans of templates: runs (end, state, size) in text order, joined while their template goes on."""
        open_: dict[int, list] = {}  # template: first word, last word, template end, covered words, versions not covered
        done = []

        def close(template: int) -> None:
            first, last, _, covered, missing = open_.pop(template)
            share = covered / self.sizes[template]
            if share >= COVER and not missing:
                done.append((self.labels[template], first, last, min(1.0, share)))

        for end, state, size in runs:
            for template, stop in self.automaton.ends[state].items():
                if template < self.n_phrases:
                    continue
                chain, said = open_.get(template), range(stop - size, stop)
                if chain and end - size - chain[1] <= MAX_GAP and stop - size >= chain[2] - 1 and end > chain[1]:
                    fresh = min(size, stop - chain[2])
                    open_[template] = [chain[0], end - 1, stop, chain[3] + max(0, fresh), chain[4].difference(said)]
                else:
                    if chain:
                        close(template)
                    open_[template] = [end - size, end - 1, stop, size, self.versions[template].difference(said)]
        for template in list(open_):
            close(template)
        return sorted(_best(done), key=lambda s: (s[1], s[2], s[0]))


def _best(spans: list) -> list:
    """Spans (label, first, last, covered) without those that share most of their words, or of the other's, with a better one of another label."""
    kept: list = []
    for span in sorted(set(spans), key=lambda s: (-s[3], s[1] - s[2], s)):
        rank, size = (span[3], span[2] - span[1]), span[2] - span[1] + 1
        if not any(
            k[0] != span[0] and (k[3], k[2] - k[1]) > rank and 2 * (min(k[2], span[2]) - max(k[1], span[1]) + 1) > min(size, k[2] - k[1] + 1)
            for k in kept
        ):
            kept.append(span)
    return kept


_RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))),
])
_RESULT_DDL = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
    "spans:array<struct<label:string,first:bigint,last:bigint,covered:double>>>"
)


def summarise(found) -> dict:
    n_words, base, spans = found
    base_labels, labels = sorted({x for _, x in base}), sorted({x for _, x in base} | {s[0] for s in spans})
    return {
        "n_words": n_words, "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(base_labels), "labels": ",".join(labels),
        "score": 1.0 if base else max((s[3] for s in spans), default=0.0),
        "spans": [dict(zip(("label", "first", "last", "covered"), s, strict=True)) for s in spans],
    }


def scan_licences(docs: DataFrame, name: str = "licences") -> DataFrame:
    """``docs`` plus a struct column ``name`` of what the scanner found in ``text``, one row per row.

    Its fields: n_words, n_base (places of base phrases), first_word and
    last_word (least and greatest start of those, else null), base_labels,
    labels (with those of templates), score (1 with a base phrase, else the
    share of the best covered template) and spans.

    Null and empty texts have no words and no labels. Texts are scanned whole,
    in memory that grows with one text. Equal texts get equal results. A column
    that is already called ``name``, in whatever case, is replaced. An empty
    table gives an empty result.
    """
    kept = docs.select(*[F.col(quoted(c)) for c in others(docs.columns, (name,))])
    place = kept.columns.index("text")

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            found = [summarise(scanner.scan(t)) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _RESULT)], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, extended(kept.schema, f"`{name}` {_RESULT_DDL}"))
