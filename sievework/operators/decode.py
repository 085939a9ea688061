"""Decoders: from scores of one document to typed results.

``flat`` resolution is used on the boundary path, greedy on the span path. Thresholds of single items
count on both paths unless switched off.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from sievework.functions import heads
from sievework.operators.scorers import Scorer
from sievework.operators.spans import assignment, flat
from sievework.schema import Classification, Field, Mode, Schema, Structure

MASKED = -5000.0
#: A probability of nought costs this much at most: the logarithm of it is taken.
LEAST = 1e-38
#: What a place that is not allowed costs above the dearest one.
ABSENT_COST, FOREIGN_COST = 50.0, 1000.0


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def softmax(xs: list[float]) -> list[float]:
    return heads.softmax(np.array(xs, dtype=float)).tolist()


@dataclass(frozen=True)
class Options:
    threshold: float = 0.5
    confidence: bool = True
    spans: bool = True
    path: str = "boundary"
    item_thresholds: bool = True
    #: whether a classification's own threshold counts; else the call's does
    task_thresholds: bool = False

    def least(self, own: float | None) -> float:
        return own if self.item_thresholds and own is not None else self.threshold


def greedy(hits):
    kept: list = []
    for h in sorted(hits, key=lambda h: -h[0]):
        if all(h[2] <= k[1] or k[2] <= h[1] for k in kept):
            kept.append(h)
    return kept


def probable(hits, least: float):
    """(probability, start, end) of hits that are not masked and reach the threshold."""
    return [(p, a, b) for logit, a, b in hits if logit > MASKED and (p := sigmoid(logit)) >= least]


def resolved(hits, least: float, path: str):
    found = probable(hits, least)
    return flat(found) if path == "boundary" else greedy(found)


def entities(scored: dict, schema: Schema, o: Options) -> dict[str, list]:
    """type -> hits, every declared type present."""
    return {e.name: resolved(scored.get(e.name, []), o.least(e.threshold), o.path) for e in schema.entities if e.name not in schema.hidden}


def classification(logits: list[float], c: Classification, o: Options) -> list[tuple[str, float]]:
    """Chosen (label, probability). Multi-label on the boundary path falls back to the likeliest."""
    if not c.multi_label:
        p = softmax(logits)
        order = range(len(p)) if o.path == "span" else range(len(p) - 1, -1, -1)  # ties: first, or last
        best = max(order, key=lambda i: p[i])
        return [(c.labels[best], p[best])]
    p = [sigmoid(x) for x in logits]
    least = c.threshold if o.task_thresholds else o.threshold
    return [(x, v) for x, v in zip(c.labels, p) if v >= least or (o.path == "boundary" and v == max(p))]


def endpoints(kind: str, found: dict[str, list], scored: dict, least: float) -> list[tuple[int, int]]:
    """Spans that may be one end of a relation: of that type if declared, else of all types; without any, proposals for the role."""
    if kind in found:
        return sorted({h[1:] for h in found[kind]})
    every = sorted({h[1:] for hits in found.values() for h in hits})
    return every or sorted({h[1:] for h in flat(probable(scored.get(kind, []), least))})


def relations(scorer: Scorer, schema: Schema, found: dict, scored: dict, tokens: list, o: Options) -> dict[str, list]:
    """relation -> (probability, head, tail), likeliest first, every declared relation present."""
    out = {}
    for r in schema.relations:
        least, rows = o.least(r.threshold), {}
        for h in endpoints(r.fields[0], found, scored, o.threshold):
            for t in endpoints(r.fields[1], found, scored, o.threshold):
                if h != t and (h, t) not in rows and (p := sigmoid(scorer.pair(r.name, h, t, len(tokens), tokens))) >= least:
                    rows[h, t] = p
        out[r.name] = sorted(((p, h, t) for (h, t), p in rows.items()), key=lambda x: -x[0])
    return out


def counted_relations(scorer: Scorer, schema: Schema, text: str, tokens: list, scored: dict, o: Options) -> dict[str, list]:
    """relation -> (best head, best tail) of each instance that has both, as hits; the form of the span path."""
    out: dict = {}
    for r in schema.relations:
        least, out[r.name] = o.least(r.threshold), []
        fields = list(r.fields[:2])
        for k in range(scorer.count(text, tokens, r.name, fields)):
            own = scorer.instance(text, tokens, r.name, fields, k, scored)
            ends = [max(probable(own.get(f, []), least), key=lambda h: h[0], default=None) for f in fields]
            if None not in ends:
                out[r.name].append(tuple(ends))
    return out


def counted_records(scorer: Scorer, s: Structure, text: str, tokens: list, scored: dict, texts, o: Options) -> list[dict[str, list]]:
    """A record for each instance that has anything; the form of the span path."""
    fields, out = [f.name for f in s.fields], []
    for k in range(scorer.count(text, tokens, s.name, fields)):
        out += record(s, scorer.instance(text, tokens, s.name, fields, k, scored), texts, o)
    return out


def field_hits(f: Field, scored: dict, texts, o: Options):
    hits = resolved(scored.get(f.name, []), o.least(f.threshold), o.path)
    return [h for h in hits if (not f.choices or texts(h) in f.choices) and all(v.accepts(texts(h)) for v in f.validators)]


def record(s: Structure, scored: dict, texts, o: Options) -> list[dict[str, list]]:
    """One record of all fields; none if every field is empty."""
    made = {}
    for f in s.fields:
        hits = field_hits(f, scored, texts, o)
        made[f.name] = sorted(hits, key=lambda h: -h[0])[:1] if f.effective_cardinality.scalar else hits
    return [made] if any(made.values()) else []


def anchored(scorer: Scorer, s: Structure, scored: dict, texts, o: Options) -> list[dict[str, list]]:
    """A record for each anchor span; single fields by cheapest assignment with absence, lists to their best owner."""
    anchors = sorted(probable(scored.get(s.anchor, []), o.threshold), key=lambda h: -h[0])
    if not anchors:
        return record(s, scored, texts, o)
    near = lambda a, c: scorer.near(s.name, a, c)
    records = [{s.anchor: [a]} for a in anchors]
    for f in s.fields:
        if f.name == s.anchor:
            continue
        cands = [c for c in field_hits(f, scored, texts, o)]
        least = o.least(f.threshold)
        for r in records:
            r[f.name] = []
        if not cands:
            continue
        if not f.effective_cardinality.scalar:
            for c in cands:
                p = [sigmoid(near(a, c)) for a in anchors]
                k = p.index(max(p))
                if p[k] >= least:
                    records[k][f.name].append((min(c[0], p[k]), c[1], c[2]))
            continue
        probs = [softmax([scorer.nobody(s.name, a, f.name), *(near(a, c) for c in cands)]) for a in anchors]
        cost = [[-math.log(max(p, LEAST)) for p in row] for row in probs]
        dear = max(max(row[1:]) for row in cost)
        table = []
        for i, row in enumerate(cost):
            own = row[0] if f.effective_cardinality.optional else dear + ABSENT_COST
            table.append(row[1:] + [own if i == j else dear + FOREIGN_COST for j in range(len(anchors))])
        for i, j in enumerate(assignment(table)):
            if j < len(cands) and (probs[i][j + 1] >= least or not f.effective_cardinality.optional):
                records[i][f.name] = [(min(cands[j][0], probs[i][j + 1]), *cands[j][1:])]
    return sorted(records, key=lambda r: r[s.anchor][0][1:])


def attributes(scorer: Scorer, schema: Schema, tokens: list, kind: str, span: tuple) -> dict:
    """group -> (label, probability) or a list of them, for one span of an entity type."""
    out: dict = {}
    for name, g in schema.attributes:
        if g.applies_to is not None and kind not in g.applies_to:
            out[name] = [] if g.multi_label else None
            continue
        logits = [scorer.attribute(tokens, span, name, x) for x in g.labels]
        if g.multi_label:
            out[name] = [{"label": x, "confidence": p} for x, v in zip(g.labels, logits) if (p := sigmoid(v)) >= g.threshold]
        else:
            p = softmax(logits)
            k = p.index(max(p))
            out[name] = {"label": g.labels[k], "confidence": p[k]}
    return out


def document(text: str, tokens: list, schema: Schema, scorer: Scorer, o: Options) -> dict:
    """All results of one text, with offsets and confidences: entities first, for what depends on them."""
    def shown(h):
        a, b = tokens[h[1]][1], tokens[h[2] - 1][2]
        return {"text": text[a:b], "confidence": h[0], "start": a, "end": b}

    piece = lambda h: shown(h)["text"]
    names = [e.name for e in schema.entities if e.name not in schema.hidden]
    roles = [f for r in schema.relations for f in r.fields[:2]]
    fields = [f.name for s in schema.structures for f in s.fields]
    asked = list(dict.fromkeys(names + roles + fields))
    scored = scorer.spans(text, tokens, asked) if asked else {}
    found = entities(scored, schema, o)
    out: dict = {}
    if names:
        out["entities"] = {k: [shown(h) | (attributes(scorer, schema, tokens, k, h[1:]) if schema.attributes else {}) for h in hits] for k, hits in found.items()}
    for c in schema.classifications:
        got = [{"label": x, "confidence": p} for x, p in classification(scorer.labels(text, tokens, c.task, c.labels), c, o)]
        out[c.task] = got if c.multi_label else got[0]
    for s in schema.structures:
        if s.mode is Mode.NATURAL:
            rows = anchored(scorer, s, scored, piece, o)
        else:
            rows = counted_records(scorer, s, text, tokens, scored, piece, o) if o.path == "span" else record(s, scored, piece, o)
        out[s.name] = [{k: list(map(shown, v)) for k, v in r.items()} for r in rows]
    if schema.relations and o.path == "span":
        made = counted_relations(scorer, schema, text, tokens, scored, o)
        out["relation_extraction"] = {k: [{"head": shown(h), "tail": shown(t)} for h, t in v] for k, v in made.items()}
    elif schema.relations:
        made = relations(scorer, schema, found, scored, tokens, o)
        side = lambda p, s: shown((p, *s))
        out["relation_extraction"] = {k: [{"head": side(p, h), "tail": side(p, t)} for p, h, t in v] for k, v in made.items()}
    return out
