"""License scans with a positional index of rare words.

Templates are short notices of public licences, as words.  Their words' rarity (IDF) is counted over all documents.  Of a
template's words that a text has, those of the highest IDF are looked up in the template's postings; each place of such a
word, less its place in the template, is a vote for that offset, weighed by its IDF, so a notice shows as votes of
different words at about one offset.  Where the votes outweigh a share of what these words could give, the window is read:
it is reported if the mandatory phrases stand in it and its words have a share of the template's IDF.

Three base phrases are searched for beside: wherever their words stand consecutively.

Words: A-Z in lower case, runs of letters, digits and characters beyond ASCII.  Null texts are empty: no words, no
places, score 0.  Texts are read whole, however long: votes grow with the places of a template's rare words.  Of templates
of one label at one place the best counts, of equal ones the first.  Repeated rows are each reported; columns other than
id and text are not read; an empty table gives an empty one.  The scan maps rows; the only shuffle sums a few hundred
document frequencies.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced

#: Base phrases and their labels.
BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: phrases that must stand in the window of a match
    mandatory: tuple[str, ...]


#: Notices by which licences are commonly named in files.
TEMPLATES = (
    Template("mit", "MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("permission is hereby granted", "without restriction")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    Template("gpl-3.0", "is licensed under the GNU General Public License, version 3", ("gnu general public license", "3")),
    Template("gpl-2.0", "is licensed under the GNU General Public License, version 2", ("gnu general public license", "2")),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name", "endorse or promote products derived from this software")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    # The notice that the Free Software Foundation asks for.
    Template("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2")),
    # Titles.
    Template("apache-2.0", "Apache License, Version 2.0", ("apache license", "2 0")),
    Template("gpl-3.0", "GNU General Public License, Version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "GNU General Public License, Version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl", "GNU Affero General Public License", ("gnu affero general public license",)),
    Template("mpl-2.0", "Mozilla Public License, Version 2.0", ("mozilla public license", "2 0")),
    Template("bsd", "BSD 3-Clause License", ("bsd 3 clause",)),
    Template("bsd", "BSD 2-Clause License", ("bsd 2 clause",)),
    Template("isc", "ISC License", ("isc license",)),
    Template("cc0", "CC0 1.0 Universal", ("cc0",)),
    Template("cc-by", "Creative Commons Attribution 4.0 International", ("creative commons attribution 4 0",)),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license", "2 0")),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license", "1 0")),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    Template("artistic-2.0", "The Artistic License 2.0", ("artistic license 2 0",)),
    Template("eupl-1.2", "Licensed under the European Union Public Licence, version 1.2", ("european union public licence", "1 2")),
    Template("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("sil open font license", "1 1")),
    Template("wtfpl", "Do What The Fuck You Want To Public License", ("what the fuck you want to public license",)),
    Template("ms-pl", "Microsoft Public License (Ms-PL)", ("microsoft public license",)),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("you may not use this file except in compliance with the license", "apache org licenses license 2 0")),
    Template("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT", ("the software is provided as is without warranty of any kind", "noninfringement")),
)

_WORD_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_WORD_BYTES).split()


class Index:
    """Postings of the templates' words, the rarity of each, and the words by which a text is passed over at once.

    ``anchors`` is how many of a template's words in a text, the rarest, are looked up; ``reach`` by how many words a place
    may be off.
    """

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, idf: dict[bytes, float] | None = None, anchors: int = 4, share: float = 0.5, reach: int = 3):
        self.anchors, self.reach = anchors, reach
        self.templates, self.share = templates, share
        self.tokens = [words(t.text) for t in templates]
        self.mandatory = [[words(p) for p in t.mandatory] for t in templates]
        every = sorted({w for ws in self.tokens for w in ws} | {w for ps in self.mandatory for p in ps for w in p})
        self.idf = {w: (idf or {}).get(w, 1.0) for w in every}
        self.postings: list[dict[bytes, list[int]]] = []
        for ws in self.tokens:
            places: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(ws):
                places[w].append(i)
            self.postings.append(places)
        self.rarest = [sorted(p, key=lambda w: (-self.idf[w], w)) for p in self.postings]
        self.needed = [frozenset(w for p in ps for w in p) for ps in self.mandatory]
        self.weight = [sum(self.idf[w] for w in p) for p in self.postings]
        # A text without the rarest mandatory word of any template has none of them.
        self.watched = {min(ws, key=lambda w: (-self.idf[w], w)) for ws in self.needed} | {p[0] for p in BASE_WORDS}

    def vocabulary(self) -> list[bytes]:
        return sorted(self.idf)

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[int, str, float]]]:
        """Number of words, base places (start, label), matches (start, label, score)."""
        ws = words(text)
        if self.watched.isdisjoint(ws):
            return len(ws), [], []
        here = set(ws)
        possible = [k for k, needed in enumerate(self.needed) if here.issuperset(needed)]
        rare = {k: [w for w in self.rarest[k] if w in here][: self.anchors] for k in possible}
        wanted = {w for found in rare.values() for w in found} | {p[0] for p in BASE_WORDS}
        base, at = [], defaultdict(list)
        for i, w in enumerate(ws):
            if w in wanted:
                at[w].append(i)
        for phrase, label in zip(BASE_WORDS, BASE.values(), strict=True):
            n = len(phrase)
            base.extend((i, label) for i in at.get(phrase[0], ()) if ws[i : i + n] == phrase)
        found: list[tuple[float, int, int, int, str]] = []
        for k in possible:
            for start in self._offsets(k, rare[k], at):
                match = self._read(k, start, ws)
                if match:
                    found.append(match)
        # Several templates of a label may match at one place: the best stays.
        best: dict[str, list[tuple[int, int, int, float]]] = defaultdict(list)
        for score, start, end, place, label in sorted(found, key=lambda x: (-x[0], *x[1:])):
            if all(end < a or start > b for a, b, _, _ in best[label]):
                best[label].append((start, end, place, score))
        return len(ws), sorted(base), sorted((place, label, score) for label, xs in best.items() for _, _, place, score in xs)


    def _offsets(self, k: int, rare: list[bytes], at: dict[bytes, list[int]]) -> list[int]:
        """Offsets of template k to which the rare words' votes, of each word once and within ``reach``, give half of what they could."""
        votes = sorted((j - i, w) for w in rare for i in self.postings[k][w] for j in at[w])
        enough = self.share * sum(self.idf[w] for w in rare)
        held: Counter = Counter()
        total, last, out = 0.0, 0, []
        for first, (offset, w) in enumerate(votes):
            held[w] += 1
            total += self.idf[w] if held[w] == 1 else 0.0
            while votes[last][0] < offset - self.reach:
                old = votes[last][1]
                held[old] -= 1
                total -= self.idf[old] if not held[old] else 0.0
                last += 1
            if total >= enough - 1e-9:
                out.extend(o for o, _ in votes[last : first + 1] if not out or o > out[-1])
        return out

    def _read(self, k: int, start: int, ws: list[bytes]) -> tuple[float, int, int, int, str] | None:
        """(score, start, end, first word that counts, label) if the template stands at about this offset."""
        n = len(self.tokens[k])
        lo, hi = max(0, start - self.reach), max(0, start + n + self.reach)
        window = ws[lo:hi]
        if not all(_stands(p, window) for p in self.mandatory[k]):
            return None
        # A word counts where it stands within reach of its place in the template.
        near, place = set(), None
        for j, w in enumerate(window):
            if any(abs(lo + j - start - i) <= self.reach for i in self.postings[k].get(w, ())):
                near.add(w)
                place = j if place is None else place
        score = sum(self.idf[w] for w in near) / self.weight[k]
        if score < (self.share if len(self.mandatory[k]) > 1 else self.share / 2):
            return None
        return min(1.0, score), start, start + n - 1, lo + (place or 0), self.templates[k].label


BASE_WORDS = [[w.encode() for w in p] for p in BASE]


def _stands(phrase: list[bytes], ws: list[bytes]) -> bool:
    n = len(phrase)
    return any(ws[i : i + n] == phrase for i, w in enumerate(ws) if w == phrase[0])


def document_frequencies(docs: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Rows, and in how many of them each word of the vocabulary stands; over all documents, as many rows as words."""
    import pyarrow as pa

    ship(docs.sparkSession)
    wanted = frozenset(vocabulary)

    def run(batches):
        seen: Counter = Counter()
        for batch in sliced(batches, 0):
            for text in batch.column(0).to_pylist():
                seen[b""] += 1
                seen.update(wanted.intersection(words(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(text_col).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a word of the vocabulary
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found.pop(b"", 0), found


def build(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text_col: str = "text") -> Index:
    """An index whose IDF comes from all documents."""
    total, found = document_frequencies(docs, Index(templates).vocabulary(), text_col)
    idf = {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 0.01 for w in Index(templates).vocabulary()}
    return Index(templates, idf)


def scan(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of every row.

    matches: array<struct<word, label, score>>; score is the best of a row's, 1 for a base phrase.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    index = index or build(docs, text_col=text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    match = pa.struct([("word", pa.int64()), ("label", pa.string()), ("score", pa.float64())])

    def run(batches):
        for batch in sliced(batches, 1):
            rows = [index.scan(t or "") for t in batch.column(1).to_pylist()]
            n, base, own = zip(*rows, strict=True) if rows else ((), (), ())
            starts = [[i for i, _ in b] for b in base]
            listed = [",".join(sorted({x for _, x in b})) for b in base]
            both = [",".join(sorted({x for _, x in b} | {x for _, x, _ in m})) for b, m in zip(base, own, strict=True)]
            score = [1.0 if b else max((s for _, _, s in m), default=0.0) for b, m in zip(base, own, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(map(len, base), pa.int64()),
                    pa.array([min(s, default=None) for s in starts], pa.int64()),
                    pa.array([max(s, default=None) for s in starts], pa.int64()),
                    pa.array(listed, pa.string()),
                    pa.array(both, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array([[{"word": i, "label": x, "score": s} for i, x, s in m] for m in own], pa.list_(match)),
                ],
                names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
            )

    schema = f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<word:long,label:string,score:double>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
