"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a window of words at any start; a template matches a block that contains at least the threshold's share of the
template's distinct words. A window has 128 words, or half as many again as the template where that is more; a shorter
text is one block. The join is exact: every block that reaches the threshold is found, as runs of starts. Words are
ordered by their frequency over all documents, rarest first. Such a block must hold one of a template's first words in
that order, so only stretches of starts around those are looked at (prefix filter). A stretch must have enough distinct
words at all (length filter), and enough of them from its first shared word on (positional filter). In what passes the
three, each word of the template covers the starts whose windows hold it; sums of those intervals give the containment at
every start, in time that only grows with the places of the template's words. Templates are few, so they and the counts
of their words are what the workers get; documents are never shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_schema, map_batches, slices, small_batches, text_column

# Phrases and labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices of public licenses, and their labels.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
)

THRESHOLD, WINDOW, STRETCH = 0.8, 128, 1.5
#: Templates of a table, at most: workers hold them all.
MOST = 10_000
_TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().translate(_TO_WORDS).split()


def places(words: list[bytes], phrases: Sequence[tuple[str, str]] = PHRASES) -> list[tuple[int, str]]:
    """(index of the first word, label) wherever a phrase's words stand in a row."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        key, before, index = f" {phrase} ".encode(), 0, 0
        at = line.find(key)
        while at >= 0:
            index += line.count(b" ", before, at)  # blanks since the last place
            before = at
            out.append((index, label))
            at = line.find(key, at + 1)
    return out


def window_of(template_words: int) -> int:
    return max(WINDOW, math.ceil(STRETCH * template_words))


class Templates:
    """The templates' words in the order of global frequency, and an index of their prefixes.

    Templates without a word match nothing.
    """

    def __init__(self, templates: Sequence[tuple[str, str]], seen: dict[bytes, int], threshold: float, window: Callable[[int], int] = window_of) -> None:
        listed = [(label, words) for label, t in templates if (words := words_of(t))]
        self.rank = {w: i for i, w in enumerate(sorted({w for _, ws in listed for w in ws}, key=lambda w: (seen.get(w, 0), w)))}
        self.labels = [label for label, _ in listed]
        self.windows = [window(len(ws)) for _, ws in listed]
        self.sorted = [sorted(self.rank[w] for w in set(ws)) for _, ws in listed]
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in self.sorted]
        self.prefix: dict[int, list[int]] = defaultdict(list)
        for k, (s, need) in enumerate(zip(self.sorted, self.need, strict=True)):
            for r in s[: len(s) - need + 1]:
                self.prefix[r].append(k)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, int, float]]:
        """(template, first start, last start, window, containment) of every run of starts whose blocks reach the threshold.

        containment is the greatest of the run; the runs of a template don't touch.
        """
        rank, at = self.rank, defaultdict(list)
        for i, w in enumerate(words):
            if (r := rank.get(w)) is not None:
                at[r].append(i)
        tried = {k for r in at for k in self.prefix.get(r, ())}
        out = []
        for k in sorted(tried):
            ranks, need, window = self.sorted[k], self.need[k], self.windows[k]
            own = [r for r in ranks if r in at]
            if len(own) < need:
                continue
            last = max(0, len(words) - window)
            for low, high in _merged([p for r in own if k in self.prefix.get(r, ()) for p in at[r]], window, last):
                here = [(r, x[bisect_left(x, low) : bisect_left(x, high + window)]) for r in own for x in (at[r],)]
                here = [p for _, p in here if p]  # the first of them, in the order of ranks, is a prefix word
                if len(here) >= need:
                    out += [(k, a, b, window, c / len(ranks)) for a, b, c in _runs(here, window, low, high, need)]
        return out


def _merged(places: list[int], window: int, last: int) -> list[tuple[int, int]]:
    """The starts, 0 to last, of windows that hold any of the places, as intervals that don't touch."""
    out: list[tuple[int, int]] = []
    for p in sorted(places):
        low, high = min(max(0, p - window + 1), last), min(p, last)
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _runs(places: list[list[int]], window: int, low: int, high: int, need: int) -> list[tuple[int, int, int]]:
    """(first, last, most) of the runs of starts from low to high whose windows hold at least `need` of the words.

    places has each word's places; what a word covers are intervals that don't touch, which open and close a count.
    """
    change: dict[int, int] = defaultdict(int)
    for word in places:
        for a, b in _merged(word, window, high):
            if b >= low:
                change[max(a, low)] += 1
                change[b + 1] -= 1
    out: list[tuple[int, int, int]] = []
    count, first, most = 0, -1, 0
    for start in sorted(change):
        count += change[start]
        if count >= need and start <= high:
            if first < 0:
                first, most = start, 0
            most = max(most, count)
        elif first >= 0:
            out.append((first, start - 1, most))
            first = -1
    return out


def read_templates(table: DataFrame) -> list[tuple[str, str]]:
    """The rows of a table (label, text) of templates; null ones are left out, and more than MOST are an error."""
    rows = table.select("label", "text").where("label IS NOT NULL AND text IS NOT NULL").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} templates")
    return sorted((r.label, r.text) for r in rows)


def word_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How often each word of a vocabulary of fixed size stands in all texts: counted in each task, then summed."""

    def run(batches):
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen.update(w for w in words_of(text) if w in vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["w", "n"])

    rows = docs.select(text_column(text_col).alias("__text")).mapInArrow(run, "w binary, n long")
    return {bytes(r.w): r.n for r in rows.groupBy("w").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] | DataFrame = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks) for each row of docs.

    base: phrases; n_base counts their places, first_word and last_word are their smallest and largest start (null
    without any). labels also has those of the matching templates (label, text; a list or a table); both are distinct,
    sorted and comma-joined. blocks has (label, first_start, last_start, window, containment) of each run of blocks that
    match. score: 1 with a phrase, else the greatest containment that matched, else 0. A null text counts as empty: no
    words, no labels, score 0. Repeated rows and null ids come out as they went in.
    """
    small_batches(docs.sparkSession)
    if isinstance(templates, DataFrame):
        templates = read_templates(templates)
    known = Templates(templates, word_counts(docs, {w for _, t in templates for w in words_of(t)}, text_col), threshold)
    rows = docs.select(id_col, text_column(text_col).alias("__text"))
    schema = f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,first_start:long,last_start:long,window:long,containment:double>>"

    kinds = arrow_schema(schema.split(", ", 1)[1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in batch.column("__text").to_pylist():
            words = words_of(text)
            base = places(words)
            found = known.matches(words)
            starts, labels = [i for i, _ in base], {x for _, x in base}
            out.append(
                {
                    "n_words": len(words), "n_base": len(base), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {known.labels[k] for k, *_ in found})),
                    "score": 1.0 if base else max((c for *_, c in found), default=0.0),
                    "blocks": [{"label": known.labels[k], "first_start": i, "last_start": j, "window": w, "containment": c} for k, i, j, w, c in found],
                }
            )
        made = pa.Table.from_pylist(out, kinds).combine_chunks().to_batches()[0]
        return pa.RecordBatch.from_arrays([batch.column(id_col), *made.columns], names=[id_col, *made.schema.names])

    return map_batches(rows, run, schema)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql() -> str:
    """The rows of scan_licenses without blocks, for a table `documents`, in DuckDB's SQL: every start is counted."""
    split = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    phrases = " UNION ALL ".join(f"SELECT rid, {_quoted(label)} AS label, unnest(list_filter(range(1, len(ws) - {n - 2}), lambda i: ws[i:i + {n - 1}] = {p.split()})) - 1 AS pos FROM d" for p, label in PHRASES for n in [len(p.split())])
    templates = ", ".join(f"({k}, {_quoted(label)}, {_quoted(t)})" for k, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {split.format("text")} AS ws FROM documents),
base AS ({phrases}),
b AS (SELECT rid, count(*) AS n, min(pos) AS low, max(pos) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
t AS (SELECT k, label, {split.format("text")} AS ws FROM (VALUES {templates}) v(k, label, text)),
tw AS (SELECT DISTINCT k, unnest(ws) AS w FROM t),
need AS (SELECT k, label, greatest({WINDOW}, ceil({STRETCH} * len(ws)))::BIGINT AS win, len(list_distinct(ws)) AS m, greatest(1, ceil({THRESHOLD} * len(list_distinct(ws)) - 1e-9)) AS need FROM t),
words AS (SELECT rid, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
hit AS (
  SELECT rid, k, w, least(greatest(0, p - win + 1), greatest(0, n - win)) AS low, least(p, greatest(0, n - win)) AS high
  FROM words JOIN tw USING (w) JOIN need USING (k)
), piece AS (
  SELECT rid, k, greatest(low, coalesce(max(high) OVER (PARTITION BY rid, k, w ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0)) AS low, high FROM hit
), change AS (
  SELECT rid, k, s, sum(x) AS x FROM (
    SELECT rid, k, low AS s, 1 AS x FROM piece WHERE low <= high UNION ALL SELECT rid, k, high + 1, -1 FROM piece WHERE low <= high
  ) GROUP BY rid, k, s
), most AS (
  SELECT rid, k, max(c) AS c FROM (SELECT rid, k, sum(x) OVER (PARTITION BY rid, k ORDER BY s) AS c FROM change) GROUP BY rid, k
), found AS (
  SELECT rid, max(c / m) AS score, list(label) AS labels FROM most JOIN need USING (k) WHERE c >= need GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.low::BIGINT AS first_word, b.high::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(string_split(b.labels, ','), []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(found.score, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN found USING (rid)
"""
