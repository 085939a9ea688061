"""Overlap resolution and deduplication of spans held in one array column a document.

A span is a struct with start, end (half-open) and score; other fields are carried along.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,score:double>"


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def by_score(spans: Column) -> Column:
    """Highest score first; equal scores keep their order."""
    keyed = F.transform(spans, lambda s, i: F.struct((-s["score"]).alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def by_place(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def greedy(spans: Column, span_type: str = SPAN) -> Column:
    """Takes spans by score, each if it overlaps none taken before; result in score order."""
    none = F.array().cast(f"array<{span_type}>")
    return F.aggregate(by_score(spans), none, lambda kept, s: F.when(F.exists(kept, lambda k: overlaps(k, s)), kept).otherwise(F.array_append(kept, s)))


def dedupe(spans: Column) -> Column:
    """Of spans with the same ends the one of highest score (the first of equal ones), ordered by place."""
    keyed = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), (-s["score"]).alias("k"), i.alias("i"), s.alias("s"))))
    first = F.filter(keyed, lambda x, i: (i == 0) | (F.get(keyed, i - 1)["a"] != x["a"]) | (F.get(keyed, i - 1)["b"] != x["b"]))
    return F.transform(first, lambda x: x["s"])


def longest(spans: Column) -> Column:
    """Drops spans that lie strictly inside another."""
    inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & ((o["start"] != s["start"]) | (o["end"] != s["end"]))
    return F.filter(spans, lambda s: ~F.exists(spans, lambda o: inside(s, o)))


def flat(hits: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Non-overlapping hits (score, start, end) of the highest total score, in order of their ends.

    Hits with the same ends count once, the best of them. Of equal totals the one with more spans wins,
    then the one whose ranked list (score down, start, end, order given) comes first.
    """
    ranked = sorted(((-s, a, b, i) for i, (s, a, b) in enumerate(hits)))
    own: dict = {}
    for key in ranked:
        own.setdefault(key[1:3], key)
    order = sorted(own.values(), key=lambda k: (k[2], k[1], k[0], k[3]))
    ends = [k[2] for k in order]
    best: list[tuple[float, int, list]] = [(0.0, 0, [])]
    for i, k in enumerate(order):
        total, n, chosen = best[bisect_right(ends, k[1], 0, i)]
        taken = (total - k[0], n + 1, sorted([*chosen, k]))
        left = best[i]
        better = (taken[0], taken[1]) > (left[0], left[1]) or (taken[:2] == left[:2] and taken[2] < left[2])
        best.append(taken if better else left)
    picked = {k[3] for k in best[-1][2]}
    return [(-k[0], k[1], k[2]) for k in order if k[3] in picked]


def most_confident(hits: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """As flat, with sums in single precision and a span taken only if the total grows; in order of place."""
    import numpy as np

    order = sorted(set(hits), key=lambda h: (h[2], h[1], -h[0]))
    seen: dict = {}
    for h in order:
        if h[1:] not in seen or seen[h[1:]][0] < h[0]:
            seen[h[1:]] = h
    order = sorted(seen.values(), key=lambda h: (h[2], h[1]))
    ends = [h[2] for h in order]
    best: list = [(np.float32(0), ())]
    for i, h in enumerate(order):
        total, chosen = best[bisect_right(ends, h[1], 0, i)]
        total = np.float32(total + np.float32(h[0]))
        best.append((total, (*chosen, i)) if total > best[i][0] else best[i])
    return sorted((order[i] for i in best[-1][1]), key=lambda h: h[1:])


def _over_arrays(rule):
    @F.pandas_udf(f"array<{SPAN}>")
    def resolved(spans: pd.Series) -> pd.Series:
        def one(row):
            if row is None:
                return None
            return [{"start": a, "end": b, "score": s} for s, a, b in rule([(float(x["score"]), int(x["start"]), int(x["end"])) for x in row])]

        return spans.map(one)

    return resolved


def resolve_flat(spans: Column) -> Column:
    return _over_arrays(flat)(spans)


def resolve_most_confident(spans: Column) -> Column:
    return _over_arrays(most_confident)(spans)


#: Merge policies by name.
POLICIES = {"allow": dedupe, "longest": lambda s: by_place(longest(dedupe(s))), "highest_confidence": lambda s: resolve_most_confident(s)}


def assignment(cost: list[list[float]]) -> list[int]:
    """For each row the column of a cheapest assignment of rows to distinct columns (rows <= columns).

    Shortest augmenting paths over reduced costs.
    """
    import numpy as np

    c = np.array(cost, dtype=float)
    rows, cols = c.shape
    row_price, col_price = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for r in range(rows):
        dist, via, done = np.full(cols, np.inf), np.full(cols, -1), np.zeros(cols, dtype=bool)
        at, base, last = r, 0.0, -1
        while True:
            through = base + c[at] - row_price[at] - col_price
            better = ~done & (through < dist)
            dist[better], via[better] = through[better], last
            open_ = np.where(done, np.inf, dist)
            last = int(np.argmin(open_))
            base = dist[last]
            done[last] = True
            if owner[last] < 0:
                break
            at = owner[last]
        for j in np.flatnonzero(done):
            if j != last or owner[j] >= 0:
                if owner[j] >= 0:
                    row_price[owner[j]] += base - dist[j]
                col_price[j] -= base - dist[j]
        row_price[r] += base
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else r
            last = before
    out = [-1] * rows
    for j, r in enumerate(owner):
        if r >= 0:
            out[r] = j
    return out
