"""Overlapping word windows over long texts, and merging what was found in them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.errors import ChunkingError
from sievework.functions.text import span_text, word_pattern
from sievework.operators.spans import POLICIES, most_confident

#: Words of a window, words that two windows share.
SIZE, OVERLAP = 384, 64
CHUNK_TYPE = "array<struct<idx:int,start_word:int,end_word:int,start:int,end:int,text:string>>"


def window_sizes(max_len: int | None = None) -> tuple[int, int]:
    """(words, overlap) for a model that takes max_len tokens."""
    room = max(max_len - OVERLAP, 32) if max_len is not None else 4032
    size = max(32, min(SIZE, room))
    return size, min(OVERLAP, size // 2)


def checked(size: int, overlap: int) -> int:
    """The step between windows."""
    if size <= 0 or overlap >= size:
        raise ChunkingError(f"windows of {size} words cannot overlap by {overlap}")
    return size - overlap


def windows(words: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """array<struct<idx,start_word,end_word>> for a number of words; one empty window for none."""
    step = checked(size, overlap)
    last = F.greatest(F.ceil((words - size) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda c: F.struct(c.alias("idx"), (c * step).alias("start_word"), F.least(c * step + size, words).alias("end_word")))


def chunks(size: int = SIZE, overlap: int = OVERLAP):
    """A column function text -> windows with their character range and text. Short texts are one window, unchanged."""
    step = checked(size, overlap)

    @F.pandas_udf(CHUNK_TYPE)
    def cut(texts: pd.Series) -> pd.Series:
        word = word_pattern()

        def one(t):
            if t is None:
                return None
            ends = [m.span() for m in word.finditer(t)]
            n = len(ends)
            if n <= size:
                return [{"idx": 0, "start_word": 0, "end_word": n, "start": 0, "end": len(t), "text": t}]
            out = []
            for c in range(-(-(n - size) // step) + 1):
                a, b = c * step, min(c * step + size, n)
                out.append({"idx": c, "start_word": a, "end_word": b, "start": ends[a][0], "end": ends[b - 1][1], "text": t[ends[a][0] : ends[b - 1][1]]})
            return out

        return texts.map(one)

    return cut


def best_label(per_chunk: Column) -> Column:
    """Of struct<label,confidence> of each window the most confident, the last of equal ones."""
    keyed = F.transform(per_chunk, lambda v, i: F.struct(v["confidence"].alias("c"), i.alias("i"), v.alias("v")))
    return F.array_max(keyed)["v"]


def canonical(value) -> str:
    """A key that does not depend on confidences or on the order of names."""

    def bare(v):
        if isinstance(v, dict):
            return {k: bare(x) for k, x in v.items() if k != "confidence"}
        return [bare(x) for x in v] if isinstance(v, list) else v

    return json.dumps(bare(value), sort_keys=True, ensure_ascii=False)


def found_confidence(value) -> float | None:
    """The first confidence found, outermost first in each branch."""
    if isinstance(value, dict):
        if isinstance(value.get("confidence"), (int, float)):
            return float(value["confidence"])
        value = list(value.values())
    if isinstance(value, list):
        return next((c for c in map(found_confidence, value) if c is not None), None)
    return None


def confidence_of(value) -> float:
    """The first confidence found, be it 0; without any, 0."""
    return found_confidence(value) or 0.0


def is_span(value) -> bool:
    return isinstance(value, dict) and "start" in value and "end" in value


def shifted(value, shift: int, text: str):
    """value with every span in it moved to the document and its text taken from there."""
    if isinstance(value, list):
        return [shifted(v, shift, text) for v in value]
    if not isinstance(value, dict):
        return value
    out = {k: shifted(v, shift, text) for k, v in value.items()}
    if is_span(value):
        out["start"], out["end"] = value["start"] + shift, value["end"] + shift
        if "text" in out:
            out["text"] = text[out["start"] : out["end"]]
    return out


def deduped(items: list, policy: str = "allow") -> list:
    """Spans by the policy and in order of place, then the rest by first appearance."""

    best: dict = {}
    for s in filter(is_span, items):
        key = (s["start"], s["end"])
        if key not in best or s.get("confidence", 0.0) > best[key].get("confidence", 0.0):
            best[key] = s
    places = sorted(best)
    if policy == "longest":
        places = [p for p in places if not any(q != p and q[0] <= p[0] and p[1] <= q[1] for q in places)]
    elif policy == "highest_confidence":
        places = [h[1:] for h in most_confident([(best[p].get("confidence", 0.0), *p) for p in places])]
    rest: dict = {}
    for v in (x for x in items if not is_span(x)):
        key = canonical(v)
        if key not in rest or confidence_of(v) > confidence_of(rest[key]):
            rest[key] = v
    return [best[p] for p in places] + list(rest.values())


def merged_value(values: list, policy: str = "allow"):
    """One value from those of all windows; null, {} and [] do not count, but one of them stays if there is nothing else."""
    given, values = values, [v for v in values if v not in (None, {}, [])]
    if not values:
        return given[0] if given else None
    if all(isinstance(v, dict) and "confidence" in v for v in values):
        return max(enumerate(values), key=lambda x: (x[1]["confidence"], x[0]))[1]
    if all(isinstance(v, list) for v in values):
        return deduped([x for v in values for x in v], policy)
    if all(isinstance(v, dict) for v in values):
        names = dict.fromkeys(k for v in values for k in v)
        return {k: merged_value([v[k] for v in values if k in v], policy) for k in names}
    return values[0]


def merge_results(text: str, chunk_starts: list[int], results: list[dict], policy: str = "allow", confidence: bool = True, spans: bool = True) -> dict:
    """The result of a document from those of its windows; declared names stay, even if nothing was found."""
    results = [shifted(r, a, text) for r, a in zip(results, chunk_starts)]
    out: dict = {}
    for name in dict.fromkeys(k for r in results for k in r):
        given = [r[name] for r in results if name in r]
        if name == "entities":
            labels = dict.fromkeys(k for g in given for k in g)
            out[name] = {label: deduped([x for g in given for x in g.get(label, [])], policy) for label in labels}
        else:
            out[name] = merged_value(given, policy)
    return stripped(out, confidence, spans)


def stripped(value, confidence: bool, spans: bool):
    """Without the parts that were not asked for; a span of which only its text is left becomes that text."""
    if isinstance(value, list):
        return [stripped(v, confidence, spans) for v in value]
    if not isinstance(value, dict):
        return value
    drop = (() if confidence else ("confidence",)) + (() if spans else ("start", "end"))
    out = {k: stripped(v, confidence, spans) for k, v in value.items() if k not in drop}
    return out["text"] if len(value) > 1 and list(out) == ["text"] else out
