"""License texts found in documents by Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words without ASCII punctuation. A window runs from a word of a
document where a bigram of the template begins to the end of such a bigram. Of all windows whose bigram set has
Dice >= t with the template's, those of the largest Dice are taken (the shorter, then the first, of equal ones) as
long as they share no word with one taken before, and are drawn out over bigrams that they already have. With Dice >= t, a set of x bigrams needs a partner of t/(2-t)*x to
(2-t)/t*x: windows of other sizes are not looked at, and stretches with more foreign bigrams than that leaves are not crossed.
Whole texts are scanned, whatever their length; a document has as many rows as it has matches.

Defined cases: null, empty and non-matching texts give no rows; repeated rows give their matches each;
of overlapping matches of several templates all are returned; an empty table gives no rows; a template
of fewer than two words matches nothing; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import text_bytes

#: Gap of the segments by hand that a test compares with; the scan does not use it.
GAP = 4
MATCHES = "doc_id long, license string, first_word long, last_word long, dice double"

#: Short notices by which works name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_PUNCTUATION = bytes(c for c in range(128) if not chr(c).isalnum())
_TO_SPACE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split()


def bounds(size: int, least: float) -> tuple[float, float]:
    """Set sizes that can reach the threshold with a set of this size (rounding must not lose one that just does)."""
    return size * least / (2 - least) - 1e-9, size * (2 - least) / least + 1e-9


def reaches(at, pair, most: float):
    """The places in runs that a window can lie in: no more than ``most`` distinct foreign bigrams between neighbours."""
    runs, start = [], 0
    for j in range(1, len(at)):
        a, z = at[j - 1] + 1, at[j]
        # the first part of a wide gap nearly always has too many; if not, all of it is looked at
        if z - a > most and (len(set(pair[a : min(z, a + 4 * int(most) + 4)])) > most or len(set(pair[a:z])) > most):
            runs.append(at[start:j])
            start = j
    return [*runs, at[start:]]


def windows(run: list[int], pair: list, own: set, least: float) -> list[tuple[float, int, int]]:
    """(Dice, first, last bigram) of the windows of a run that reach the threshold and have no equal or better one inside.

    Such a window has its first and last bigram once, so from each start the scan ends where that bigram comes again:
    all scans together take at most the run's length times the template's.
    """
    low, high = bounds(len(own), least)
    out = []
    for a in run:
        seen, hits = {pair[a]}, 1
        if 2 * hits / (len(seen) + len(own)) >= least:
            out.append((2 * hits / (len(seen) + len(own)), a, a))
        for z in range(a + 1, run[-1] + 1):
            p = pair[z]
            if p in seen:
                if p == pair[a]:
                    break
                continue
            seen.add(p)
            if len(seen) > high:
                break
            if p in own:
                hits += 1
                dice = 2 * hits / (len(seen) + len(own))
                if dice >= least:
                    out.append((dice, a, z))
    return out


def best(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """The windows that are taken, in order of place."""
    taken: list[tuple[int, int, float]] = []
    for dice, a, z in sorted(found, key=lambda w: (-w[0], w[2] - w[1], w[1])):
        i = bisect_left(taken, (a,))
        if (i == 0 or taken[i - 1][1] + 1 < a) and (i == len(taken) or z + 1 < taken[i][0]):
            taken.insert(i, (a, z, dice))
    return [(dice, a, z) for a, z, dice in taken]


def drawn_out(taken: list[tuple[float, int, int]], pair: list, own: set) -> list[tuple[float, int, int]]:
    """The windows, each as far to the right and left as its own bigrams go on, but not into the next: its Dice stays."""
    out: list[tuple[float, int, int]] = []
    for i, (dice, a, z) in enumerate(taken):
        inside = set(pair[a : z + 1])
        right = taken[i + 1][1] - 1 if i + 1 < len(taken) else len(pair)
        left = out[-1][2] + 1 if out else -1
        for k in range(z + 1, right):
            if pair[k] not in inside:
                break
            z = k if pair[k] in own else z
        for k in range(a - 1, left, -1):
            if pair[k] not in inside:
                break
            a = k if pair[k] in own else a
        out.append((dice, a, z))
    return out


def scan_rows(templates: dict[str, str], least: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        number: dict[bytes, int] = {}
        sets = []
        for name, text in templates.items():
            w = [number.setdefault(x, len(number) + 1) for x in words(text.encode())]
            pairs = {(a, b) for a, b in zip(w, w[1:])}
            if pairs:
                sets.append((name, pairs))
        base = len(number) + 1
        marks = []
        for name, pairs in sets:
            table = np.zeros(base * base, dtype=bool)
            table[[a * base + b for a, b in pairs]] = True
            marks.append((name, pairs, table))
        any_ = np.logical_or.reduce([m for _, _, m in marks]) if marks else np.zeros(base * base, dtype=bool)
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = words(t.as_buffer().to_pybytes())
                if len(w) < 2:
                    continue
                codes = np.fromiter((number.get(x, 0) for x in w), dtype=np.int64, count=len(w))
                pair = codes[:-1] * base + codes[1:]
                pair[(codes[:-1] == 0) | (codes[1:] == 0)] = 0
                where = np.flatnonzero(any_[pair])
                if not len(where):
                    continue
                pairs_of = None
                for name, own, table in marks:
                    at = where[table[pair[where]]]
                    low, high = bounds(len(own), least)
                    if len(at) < low or len(np.unique(pair[at])) < low:
                        continue
                    if pairs_of is None:
                        # words that no template has are numbered here, for this text only
                        mine: dict[bytes, int] = defaultdict(count(base).__next__, number)
                        every = [mine[x] for x in w]
                        pairs_of = list(zip(every, every[1:]))
                    for run_ in reaches(at.tolist(), pairs_of, high - len(own)):
                        if len({pairs_of[i] for i in run_}) < low:
                            continue
                        for dice, a, z in drawn_out(best(windows(run_, pairs_of, own, least)), pairs_of, own):
                            for col, v in zip(cols, (doc, name, a, z + 1, dice)):
                                col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.float64())], names=[x.split()[0] for x in MATCHES.split(", ")])

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per match: doc_id, license, first_word, last_word (places in the normalised text), dice."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    return narrow.mapInArrow(scan_rows(TEMPLATES if templates is None else templates, least), MATCHES)
