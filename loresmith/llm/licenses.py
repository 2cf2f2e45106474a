"""License scans: an exact set-similarity join of text blocks and license templates.

A template holds in a block when at least ``threshold`` of its distinct words stand in it, all its naming
words (those that tell it from its sisters) among them. Blocks are the windows of a text's words, of
``SLACK`` times the template's length, wherever they begin and whatever lines they wrap over.

Words are ordered by the number of texts of the corpus that hold them, rarest first. A block that
holds a template shares one of the template's first |t| - need + 1 words with it (prefix filter); its
text has at least ``need`` of the template's words (length filter), and from the first word where they meet
enough words of the order are left in both (positional filter). The filters only skip pairs that cannot
reach the threshold; of a pair that passes, every window is counted out by one pass over the places of
the template's words, so every block that holds a template is found. Windows that overlap are one
block of the result, with the largest containment.

A template gives its label unless it is outranked where it stands: by a template of another label
that holds in an overlapping block, shares ``threshold`` of its words, and has naming words beyond it.

The frequencies are those of the words of the templates: a table bounded by the template library,
counted over all texts by a distributed sum, and small enough to go to every task with it.

Defined cases: a null text is empty and has no words, blocks or labels; repeated rows are scanned
each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases of the base scan (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Template library: label, notice or paragraph of a licence's text, and the words that name it (fixed values).
TEMPLATES = (
    ("mit", "Released under the MIT License.", "mit license"),
    ("mit", "Licensed under the MIT License.", "mit license"),
    ("mit", "This project is licensed under the terms of the MIT license.", "mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "permission granted restriction"),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "permission granted sublicense sell",
    ),
    ("apache", "Released under the Apache License.", "apache license"),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache license"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', "apache license"),
    (
        "apache",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        "governing permissions limitations",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", "gnu general public"),
    ("gpl", "Released under the GNU GPL v3.", "gpl"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "gnu general public foundation",
    ),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "gnu general public received"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3.", "lesser public"),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
        "lesser public foundation",
    ),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3.", "affero public"),
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        "affero public foundation",
    ),
    ("cc-by", "Licensed under CC BY 4.0.", "cc by"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "cc by sa"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0.", "cc by nd"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0.", "cc by nc sa"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "creative commons attribution"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "creative commons attribution noderivatives"),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal.", "cc0"),
    (
        "cc0",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, "
        "including all related and neighboring rights, to the extent allowed by law.",
        "dedicated public domain waiving",
    ),
    ("bsd", "Released under the BSD License.", "bsd license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "redistribution source binary"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "redistributions retain disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "redistributions reproduce disclaimer"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "endorse promote"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla mpl"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "permission fee granted"),
    ("zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "anyone alter freely"),
    ("boost", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software', "reproduce transmit"),
    ("boost", "Distributed under the Boost Software License, Version 1.0.", "boost"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "anyone compile sell"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "eclipse"),
    ("all-rights-reserved", "All rights reserved.", "all rights reserved"),
)
THRESHOLD, SLACK = 0.8, 1.5

#: Bytes 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F part words, once A-Z are lower case (fixed values).
_TABLE = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in (c + 32 if 65 <= c <= 90 else c for c in range(256)))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # distinct, rarest first
    need: int
    names: frozenset[bytes]
    window: int  # words in a block

    def outranked_by(self, other: Template) -> bool:
        shared = sum(w in other.words for w in self.words)
        return other.label != self.label and shared >= self.need and not other.names.issubset(self.words)


class Index:
    """Templates by the words of their prefixes, in a given order of words."""

    def __init__(self, templates: Iterable[tuple[str, str, str]], threshold: float, frequency: dict[bytes, int]):
        self.rank = {w: i for i, w in enumerate(sorted({w for _, t, _ in templates for w in words_of(t)}, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates: list[Template] = []
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for label, text, names in templates:
            own = words_of(text)
            words = tuple(sorted(set(own), key=self.rank.__getitem__))
            if not words:
                continue
            need = math.ceil(threshold * len(words) - 1e-9)
            for at, w in enumerate(words[: len(words) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.templates), at))
            self.templates.append(Template(label, words, need, frozenset(words_of(names)), math.ceil(SLACK * len(own))))
        self.marks = frozenset(self.prefix)
        self.outranks = [frozenset(k for k, u in enumerate(self.templates) if t.outranked_by(u)) for t in self.templates]

    def candidates(self, held: set[bytes]) -> list[int]:
        """Templates that a text with these words of the library may hold."""
        known = sorted(held, key=self.rank.__getitem__)  # in the global order
        tried, out = set(), []
        for here, w in enumerate(known):
            for t, at in self.prefix.get(w, ()):
                if t in tried:
                    continue
                tried.add(t)  # the first word shared: later ones cannot be before it in either
                template = self.templates[t]
                if len(known) < template.need or 1 + min(len(known) - here - 1, len(template.words) - at - 1) < template.need:
                    continue
                if template.names <= held and sum(x in held for x in template.words) >= template.need:
                    out.append(t)
        return out

    def blocks(self, t: int, places: dict[bytes, list[int]]) -> list[tuple[int, int, float]]:
        """(first word, word after the last, containment) of each run of overlapping windows that hold a template."""
        template = self.templates[t]
        stands = sorted((p, w) for w in template.words for p in places.get(w, ()))
        inside: Counter = Counter()
        out, first = [], 0
        for p, w in stands:
            inside[w] += 1
            while stands[first][0] <= p - template.window:
                gone = stands[first][1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
                first += 1
            if len(inside) >= template.need and all(x in inside for x in template.names):
                begin, share = stands[first][0], len(inside) / len(template.words)
                if out and begin < out[-1][1]:
                    out[-1] = (out[-1][0], p + 1, max(out[-1][2], share))
                else:
                    out.append((begin, p + 1, share))
        return out

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int, int, float]], set[str]]:
        """All blocks (template, first word, word after the last, containment), and the labels not outranked."""
        if self.marks.isdisjoint(words):
            return [], set()
        held = self.rank.keys() & set(words)
        tried = self.candidates(held)
        if not tried:
            return [], set()
        wanted = {w for t in tried for w in self.templates[t].words}
        places: dict[bytes, list[int]] = {}
        for p, w in enumerate(words):
            if w in wanted:
                places.setdefault(w, []).append(p)
        found = [(t, *block) for t in tried for block in self.blocks(t, places)]
        labels = {self.templates[t].label for t, b, e, _ in found if not any(u in self.outranks[t] and b < e2 and b2 < e for u, b2, e2, _ in found)}
        return found, labels


def phrase_places(words: list[bytes], phrases: tuple[tuple[str, str], ...] = PHRASES) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand in a row."""
    out = []
    for phrase, label in phrases:
        want = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(want[-1], at + 1)
            except ValueError:
                break
            start = at - len(want) + 1
            if start >= 0 and words[start : at + 1] == want:
                out.append((start, label))
    return out


def frequencies(docs: DataFrame, templates: tuple[tuple[str, str, str], ...]) -> dict[bytes, int]:
    """Texts of the corpus that hold each word of the templates; at most one row a word comes back."""
    vocabulary = sorted({w for _, t, _ in templates for w in words_of(t)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = frozenset(vocabulary), Counter()
        for b in batches:
            for t in b.column(0):
                total.update(wanted.intersection(words_of(t.as_py() or "")))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vocabulary)), pa.int32()), pa.array([total[w] for w in vocabulary], pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r["word"]]: r["n"] for r in rows}


FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,template:int,first:long,words:long,containment:double>>"


def scan(spark: SparkSession, docs: DataFrame, *, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Base phrases and held templates of every row of ``docs`` (doc_id, text).

    blocks: where each template holds, by words from 0; labels: those of the templates not outranked there;
    score: the largest containment, 1 where a base phrase stands.
    """
    frequency = frequencies(docs, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, threshold, frequency)
        last_words = frozenset(p.encode().split()[-1] for p, _ in PHRASES)
        block = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())])
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(block))])
        for b in batches:
            rows = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = words_of(t.as_py() or "")
                places = [] if last_words.isdisjoint(words) else phrase_places(words)
                found, named = index.match(words)
                base = {label for _, label in places}
                starts = [s for s, _ in places]
                rows.append({
                    "doc_id": doc, "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | named)), "score": 1.0 if places else max((c for *_, c in found), default=0.0),
                    "blocks": [{"label": index.templates[k].label, "template": k, "first": begin, "words": end - begin, "containment": c} for k, begin, end, c in found],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def op4_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")


QUERIES = {"op4_license_set_join": op4_license_set_join}


def _oracle() -> str:
    """The scan by plain SQL: at every place of a template's word, the words of the window that ends there are counted."""
    rows, words = [], []
    for k, (label, text, names) in enumerate(TEMPLATES):
        own, distinct = words_of(text), sorted(set(words_of(text)))
        rows.append(f"({k}, '{label}', {len(distinct)}, {math.ceil(THRESHOLD * len(distinct) - 1e-9)}, {len(set(words_of(names)))}, {math.ceil(SLACK * len(own))})")
        words += [f"({k}, '{w.decode()}', {w in words_of(names)})".lower() for w in distinct]
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in PHRASES)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
  w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(low, '{word}') AS words FROM d),
  phrases AS (SELECT * FROM (VALUES {phrases}) AS t(phrase, label)),
  templates AS (SELECT * FROM (VALUES {", ".join(rows)}) AS t(tid, label, n, need, n_names, span)),
  twords AS (SELECT * FROM (VALUES {", ".join(words)}) AS t(tid, word, name)),
  stands AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM w),
  places AS (SELECT r, label, i FROM w, phrases, unnest(range(len(words))) AS u(i) WHERE list_contains(words, phrase[len(phrase)]) AND words[i + 1] = phrase[1] AND words[i + 1:i + len(phrase)] = phrase),
  base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY r),
  likely AS (SELECT r, tid FROM (SELECT DISTINCT r, word FROM stands) s JOIN twords USING (word) JOIN templates USING (tid) GROUP BY r, tid, need, n_names HAVING count(*) >= need AND count_if(name) = n_names),
  occ AS (SELECT r, tid, i, word, name FROM likely JOIN twords USING (tid) JOIN stands USING (r, word)),
  windows AS (SELECT r, tid, label, e.i AS last, min(b.i) AS first, count(DISTINCT b.word) / n AS share FROM occ e JOIN occ b USING (r, tid) JOIN templates USING (tid) WHERE b.i <= e.i AND b.i > e.i - span
    GROUP BY r, tid, label, e.i, n, need, n_names HAVING count(DISTINCT b.word) >= need AND count(DISTINCT b.word) FILTER (WHERE b.name) = n_names),
  ranked AS (SELECT t.tid, u.tid AS over FROM templates t, templates u WHERE t.label <> u.label
    AND (SELECT count(*) FROM twords a JOIN twords b USING (word) WHERE a.tid = t.tid AND b.tid = u.tid) >= t.need
    AND EXISTS (SELECT 1 FROM twords b WHERE b.tid = u.tid AND b.name AND NOT EXISTS (SELECT 1 FROM twords a WHERE a.tid = t.tid AND a.word = b.word))),
  numbered AS (SELECT *, sum(CASE WHEN first < reach THEN 0 ELSE 1 END) OVER (PARTITION BY r, tid ORDER BY last) AS run
    FROM (SELECT *, coalesce(max(last) OVER (PARTITION BY r, tid ORDER BY last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, -1) AS reach FROM windows)),
  blocks AS (SELECT r, tid, label, min(first) AS first, max(last) AS last, max(share) AS share FROM numbered GROUP BY r, tid, label, run),
  named AS (SELECT r, list(DISTINCT label) AS labels FROM blocks x WHERE NOT EXISTS (SELECT 1 FROM blocks y JOIN ranked ON y.tid = over WHERE ranked.tid = x.tid AND y.r = x.r AND y.first <= x.last AND x.first <= y.last) GROUP BY r),
  top AS (SELECT r, max(share) AS score FROM blocks GROUP BY r)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(named.labels, [])))), ',') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(top.score, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN top USING (r)"""


ORACLES: dict[str, str] = {"op4_license_set_join": _oracle()}
