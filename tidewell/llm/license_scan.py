"""License scans by conditional compression.

The places where a text could hold a template's wording are compressed twice: alone, and with the
template's words as raw zstandard dictionary. What the dictionary saves, as a share of the size alone,
decides: a place of which a template saves less than ``least`` thousandths is no finding, and of
templates that meet in one place the one that saves most bytes stands. Only the words of the notice
are compressed, in lower case and without marks, so neither the length of a line, nor line breaks or
the signs of comments weaken the share.

An exact check by wording follows: the word-level differences between template and the part of the text
it fits best, with the variable parts of a template (holders, works) free. A part that differs by at most
``percent`` of the template's words is a finding; a short template may differ by one word if the license's
name stands unchanged. Templates are cut into one run of words more than the differences allowed,
so one run stands unchanged in each such part, and only the places of these runs are aligned.

A finding is given with its first line, the share saved and the differences.

Defined cases: null and empty texts have no findings; a text with the same line twice has
two findings; repeated rows each have their own; no documents give no rows; other columns
are not looked at; every line of a text is read, whatever its length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import in_arrow, two_columns

#: Usual wordings of license notices; ``*`` stands for one word that may be any or missing.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD": "Distributed under the BSD 3-Clause License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "To the extent possible under law, * * * has waived all copyright and related rights to * * * under CC0 1.0.",
    "all-rights-reserved": "All rights reserved.",
}
#: Names that stand unchanged where a template too short for ``percent`` differs by one word.
LICENSE_NAMES: dict[str, str] = {
    "Apache-2.0": "Apache License, Version 2.0",
    "MIT": "MIT License",
    "BSD": "BSD 3-Clause License",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-ND-4.0": "CC BY-ND 4.0",
}
#: Words of licensing. Texts without them may still hold a notice; ``Scanner.rare`` is what no notice is without.
CANDIDATE = r"(?i)licen[sc]|copyright|permission is hereby|redistribution and use|all rights reserved|creative commons|\bCC[ 0-]"
FINDINGS = "doc_id long, line long, license string, saved_permille long, word_differences long"
MARKS = ".,;:()[]\"'!?“”‘’«»{}<>#*/%|=~_`\\-"
#: Thousandths of a notice's compressed size that its template must save.
LEAST_SAVED = 150


def wording(text: str) -> list[str]:
    """Words in lower case without the marks around them."""
    return [w for w in (x.strip(".,;:()[]\"'!?") for x in text.lower().split()) if w]


def spoken(text: str) -> list[str]:
    """As ``wording``, but without the signs of comments; a template's ``*`` stays."""
    return [w for w in (x if x == "*" else x.strip(MARKS) for x in text.lower().split()) if w]


def word_differences(template: list[str], block: list[str]) -> int:
    """Fewest words to insert, delete or replace to turn the template into some part of the block; ``*`` is free."""
    here = np.zeros(len(block) + 1, np.int64)  # the part may begin anywhere
    words = np.array(block, dtype=object)
    for t in template:
        free = t == "*"
        skip = here + (not free)
        take = here[:-1] + (0 if free else (words != t).astype(np.int64)) if len(block) else here[:0]
        best = skip.copy()
        best[1:] = np.minimum(best[1:], take)
        # more words of the block than of the template
        step = np.arange(len(best))
        here = np.minimum.accumulate(best - step) + step
    return int(here.min())


def extended(part: list[str], words: list[str], most: int) -> tuple[int, int]:
    """Fewest words to change to turn ``part`` into some beginning of ``words``, and where its last equal word ends; at most ``most`` are of interest."""
    words = words[: len(part) + most]
    here = [(j, 0) for j in range(len(words) + 1)]  # differences, end of the last equal word
    for t in part:
        free = t == "*"
        row = [(here[0][0] + (not free), here[0][1])]
        for j, w in enumerate(words, 1):
            take = (here[j - 1][0], j) if w == t else (here[j - 1][0] + (not free), here[j - 1][1])
            row.append(min(take, (here[j][0] + (not free), here[j][1]), (row[-1][0] + 1, row[-1][1])))
        here = row
    return min(here)


def pieces(template: list[str], n: int) -> list[tuple[int, int]]:
    """``n`` runs of fixed words that don't overlap, as (begin, end): fewer than ``n`` differences leave one of them whole."""
    marks = [-1, *(i for i, t in enumerate(template) if t == "*"), len(template)]
    runs = [(a + 1, b) for a, b in zip(marks, marks[1:], strict=False) if b > a + 1]
    while len(runs) < n:
        a, b = max(runs, key=lambda r: r[1] - r[0])
        runs.remove((a, b))
        runs += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return sorted(runs, key=lambda r: r[0] - r[1])[:n]


class Scanner:
    def __init__(self, templates: dict[str, str], percent: int, license_names: dict[str, str] | None = None, level: int = 3, least: int = LEAST_SAVED):
        self.names = list(templates)
        self.words = [spoken(t) for t in templates.values()]
        self.most = [min(len(w) * percent // 100, sum(x != "*" for x in w) - 1) for w in self.words]
        runs = [(k, a, b) for k, w in enumerate(self.words) for a, b in pieces(w, self.most[k] + 1)]
        for k, (name, w) in enumerate(zip(self.names, self.words, strict=True)):
            own = spoken((license_names or {}).get(name, ""))
            at = next((i for i in range(len(w)) if own and w[i : i + len(own)] == own), None)
            if at is not None and self.most[k] == 0:
                self.most[k] = 1
                runs = [r for r in runs if r[0] != k] + [(k, at, at + len(own))]
        self.anchors = [(k, a, b, f" {' '.join(self.words[k][a:b])} ") for k, a, b in runs]
        self.rare = sorted({max(self.words[k][a:b], key=lambda w: len(w) + (0 if w.isalpha() or len(w) < 3 else 3)) for k, a, b in runs})
        self.least = least
        plain = {"level": level, "write_content_size": False, "write_checksum": False}
        self.alone = zstandard.ZstdCompressor(**plain)
        raw = [" ".join(x for x in w if x != "*").encode() for w in self.words]
        self.given = [zstandard.ZstdCompressor(**plain, dict_data=zstandard.ZstdCompressionDict(t, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in raw]

    def saved(self, notice: list[str], k: int) -> tuple[int, int]:
        """Bytes of the notice's compressed size that template ``k`` saves, and the same in thousandths."""
        raw = " ".join(notice).encode()
        size = len(self.alone.compress(raw))
        less = size - len(self.given[k].compress(raw))
        return less, 1000 * less // size

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(template, differences, begin, end) for every place where a template's wording is met."""
        joined = f" {' '.join(words)} "
        places = list(accumulate((len(w) + 1 for w in words), initial=0))
        for k, a, b, anchor in self.anchors:
            at, most = joined.find(anchor), self.most[k]
            while at >= 0:
                begin = bisect_left(places, at)
                end = begin + b - a
                reach = a + most
                before, back = extended(self.words[k][:a][::-1], words[max(0, begin - reach) : begin][::-1], most)
                after, on = extended(self.words[k][b:], words[end : end + len(self.words[k]) - b + most], most)
                if before + after <= most:
                    yield k, before + after, begin - back, end + on
                at = joined.find(anchor, at + 1)

    def find(self, text: str) -> list[tuple[int, str, int, int]]:
        """(line, license, saved, differences) of the notices in a text, in their order.

        Of notices that overlap, the one whose template saves most bytes stands; of those, the one with the fewest
        differences for its length.
        """
        lines = text.split("\n")
        words, line_of = [], []
        for i, line in enumerate(lines):
            for x in line.split():
                if w := x.lower().strip(MARKS):
                    words.append(w)
                    line_of.append(i)
        ranked = []
        for k, n, a, b in set(self.matches(words)):
            less, share = self.saved(words[a:b], k)
            if share >= self.least:
                ranked.append((-less, 100 * n // len(self.words[k]), -len(self.words[k]), self.names[k], a, b, n, share))
        taken: list[int] = []  # begins and ends of the notices that stand, by place
        found = []
        for *_, name, a, b, n, share in sorted(ranked):
            at = bisect_right(taken, a)
            if at % 2 or (at < len(taken) and taken[at] < b):
                continue
            taken[at:at] = [a, b]
            found.append((a, line_of[a], name, share, n))
        return [x[1:] for x in sorted(found)]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, percent: int = 12, least: int = LEAST_SAVED) -> DataFrame:
    """A row for each finding: doc_id, line (from 0), license, saved_permille, word_differences; no shuffle.

    Texts without any word that a notice can't be without don't leave the JVM.
    """
    known = dict(templates or TEMPLATES)
    rare = Scanner(known, percent, LICENSE_NAMES).rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, percent, LICENSE_NAMES, least=least)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                rows += [(doc_id.as_py(), *found) for found in scanner.find(text.as_py())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "line", "license", "saved_permille", "word_differences"])

    own = two_columns(docs, key, text).withColumn("low", F.lower("text"))
    return own.where(reduce(Column.__or__, [F.contains("low", F.lit(w)) for w in rare])).select("doc_id", "text").transform(in_arrow, run, FINDINGS)
