"""Scorers: where the numbers come from. Each works on one document at a time and is sent to executors whole.

Lexical: rules, no weights; exact and easy to mirror in SQL. Precomputed: logits given by the user.
LinearHeads: the numeric heads over token states from a table of vectors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from sievework.errors import CapabilityError
from sievework.functions import heads as h
from sievework.functions.text import lowered, token_id

MASK = -10_000.0
#: Heads that a schema may need.
HEADS = ("entities", "classifications", "json_structures", "relations", "attributes")


class Scorer:
    name, heads = "none", frozenset()

    def require(self, needed: Sequence[str]) -> None:
        for head in needed:
            if head not in self.heads:
                raise CapabilityError(self.name, head)

    def spans(self, text: str, tokens: list, queries: Sequence[str]) -> dict[str, list[tuple[float, int, int]]]:
        """query -> (logit, first token, last token + 1)."""
        raise NotImplementedError

    def labels(self, text: str, tokens: list, task: str, labels: Sequence[str]) -> list[float]:
        raise NotImplementedError

    def pair(self, relation: str, head: tuple, tail: tuple, n: int, tokens: list | None = None) -> float:
        raise NotImplementedError

    def attribute(self, tokens: list, span: tuple, group: str, label: str) -> float:
        raise NotImplementedError

    def near(self, structure: str, anchor: tuple, candidate: tuple) -> float:
        """How well a field's candidate goes with an anchor; both (probability, first token, last token + 1)."""
        raise NotImplementedError

    def nobody(self, structure: str, anchor: tuple, field: str) -> float:
        """The same for no candidate at all."""
        return 0.0

    def count(self, text: str, tokens: list, task: str, fields: Sequence[str]) -> int:
        """Instances of a relation or structure, on the span path."""
        return 1

    def instance(self, text: str, tokens: list, task: str, fields: Sequence[str], k: int, scored: dict) -> dict[str, list]:
        """field -> hits of the k-th instance; ``scored`` has those of all."""
        return {f: scored.get(f, []) for f in fields}


#: Most instances that are counted.
MOST_INSTANCES = 19


@lru_cache(maxsize=1 << 18)
def rule_logit(pattern: str, logit: float, piece: str) -> float | None:
    """The rule's logit if its pattern, searched for, takes the whole piece."""
    import re

    m = re.search(pattern, piece)
    return logit if m and m.span() == (0, len(piece)) else None


@dataclass(frozen=True)
class Lexical(Scorer):
    """Rules: entities by pattern, labels by keyword, pairs and records by distance, attributes by words near by.

    folded: whether patterns are held against the text in lower case, as tokens are."""

    entities: tuple[tuple[str, str, float], ...] = ()
    keywords: tuple[tuple[str, str, str, float], ...] = ()
    width: int = 4
    per_token: float = 0.25
    bias: float = -1.0
    relation_base: float = 2.0
    per_gap: float = 0.1
    near_words: int = 5
    absent: float = 0.0
    folded: bool = False
    name: str = "lexical"
    heads: frozenset = field(default=frozenset(HEADS))

    def spans(self, text, tokens, queries):
        text = lowered(text) if self.folded else text
        rules = {q: [(pattern, logit) for kind, pattern, logit in self.entities if kind == q] for q in queries}
        out: dict[str, list] = {q: [] for q in queries}
        ruled = [(out[q].append, pattern, logit) for q, own in rules.items() for pattern, logit in own if len(own) == 1]
        several = [(q, own) for q, own in rules.items() if len(own) > 1]
        starts, ends = [t[1] for t in tokens], [t[2] for t in tokens]
        for a, start in enumerate(starts):
            for b in range(a, min(len(tokens), a + self.width)):
                piece = text[start : ends[b]]
                for add, pattern, logit in ruled:
                    if (x := rule_logit(pattern, logit, piece)) is not None:
                        add((x - self.per_token * (b - a), a, b + 1))
                for q, own in several:
                    hits = [x for pattern, logit in own if (x := rule_logit(pattern, logit, piece)) is not None]
                    if hits:
                        out[q].append((max(hits) - self.per_token * (b - a), a, b + 1))
        return out

    def labels(self, text, tokens, task, labels):
        times: dict[str, int] = {}
        for t in tokens:
            times[t[0]] = times.get(t[0], 0) + 1
        return [self.bias + sum(w * times.get(k, 0) for t, x, k, w in self.keywords if (t, x) == (task, label)) for label in labels]

    def pair(self, relation, head, tail, n, tokens=None):
        gap = max(head[0], tail[0]) - min(head[1], tail[1])
        return self.relation_base - self.per_gap * max(gap, 0)

    def attribute(self, tokens, span, group, label):
        window = [t[0] for t in tokens[max(0, span[0] - self.near_words) : span[1] + self.near_words]]
        return self.bias + sum(w * window.count(k) for t, x, k, w in self.keywords if (t, x) == (group, label))

    def near(self, structure, anchor, candidate):
        return self.relation_base - self.per_gap * max(max(anchor[1], candidate[1]) - min(anchor[2], candidate[2]), 0)

    def nobody(self, structure, anchor, field):
        return self.absent

    def _begins(self, text, tokens, fields, scored=None):
        hits = (scored if scored is not None else self.spans(text, tokens, fields[:1])).get(fields[0], [])
        return sorted({a for _, a, _ in hits})[:MOST_INSTANCES]

    def count(self, text, tokens, task, fields):
        """An instance for each place where the first field is found."""
        return len(self._begins(text, tokens, fields))

    def instance(self, text, tokens, task, fields, k, scored):
        """The hits from one such place to the next; the first instance has what comes before, too."""
        begins = self._begins(text, tokens, fields, scored)
        low, high = begins[k] if k else 0, begins[k + 1] if k + 1 < len(begins) else len(tokens)
        return {f: [x for x in scored.get(f, []) if low <= x[1] < high] for f in fields}


@dataclass(frozen=True)
class Precomputed(Scorer):
    """Span logits by query, as in a replay: query -> ((logit, start, end), ...)."""

    logits: tuple[tuple[str, tuple[tuple[float, int, int], ...]], ...] = ()
    name: str = "precomputed"
    heads: frozenset = field(default=frozenset({"entities"}))

    def spans(self, text, tokens, queries):
        given = dict(self.logits)
        return {q: list(given.get(q, ())) for q in queries}


@dataclass(frozen=True, eq=False)
class LinearHeads(Scorer):
    """Heads with weights (see functions.heads) over vectors of words, found in ``table`` by token id.

    weights: span {start, end, out}, count, instances {places, input, hidden, up, down}, label, pair
    {first, second, bilinear, gate, linear}, film {scale, shift, first, second}. What a query, label or
    relation means is the mean of the vectors of its words.
    """

    table: np.ndarray
    weights: dict
    width: int = 8
    name: str = "linear heads"
    heads: frozenset = field(default=frozenset(HEADS))

    @classmethod
    def seeded(cls, d: int = 8, words: int = 997, width: int = 4, seed: int = 0) -> LinearHeads:
        """Untrained weights, for tests and as a template of shapes."""
        g = np.random.default_rng(seed)
        w = lambda *shape: g.normal(size=shape) / np.sqrt(shape[-1])
        two = lambda i, o: ((w(2 * d, i), np.zeros(2 * d)), (w(o, 2 * d), np.zeros(o)))
        weights = {
            "span": {"start": two(d, d), "end": two(d, d), "out": two(2 * d, d)}, "count": two(d, MOST_INSTANCES + 1),
            "instances": {"places": w(MOST_INSTANCES, d), "input": w(3 * d, d), "hidden": w(3 * d, d), "up": w(2 * d, 2 * d), "down": w(d, 2 * d)},
            "label": two(2 * d, 1), "film": {"scale": w(d, d), "shift": w(d, d), "first": two(d, 1)[0], "second": two(d, 1)[1]},
            "pair": {"first": (w(2 * d, 5 * d + 2), np.zeros(2 * d)), "second": (w(1, 2 * d), np.zeros(1)), "bilinear": w(d, d), "gate": w(d), "linear": w(2 * d)},
        }
        return cls(w(words, d), weights, width)

    def states(self, words: Sequence[str]):
        return self.table[[token_id(x) % len(self.table) for x in words]] if len(words) else np.zeros((0, self.table.shape[1]))

    def meaning(self, name: str):
        return self.states(name.lower().replace("_", " ").split() or [""]).mean(axis=0)

    def _spans(self, tokens, queries):
        words = self.states([t[0] for t in tokens])
        if not len(words):
            return np.zeros((len(queries), 0, self.width))
        return h.span_scores(h.span_states(words, self.width, self.weights["span"]), queries)

    def _hits(self, logits, n):
        return [(float(logits[a, b]), a, a + b + 1) for a in range(n) for b in range(min(self.width, n - a))]

    def spans(self, text, tokens, queries):
        logits = self._spans(tokens, np.stack([self.meaning(q) for q in queries]))
        return {q: self._hits(x, len(tokens)) for q, x in zip(queries, logits)}

    def labels(self, text, tokens, task, labels):
        words = self.states([t[0] for t in tokens])
        whole = words.mean(axis=0) if len(words) else np.zeros(self.table.shape[1])
        return h.class_logits(np.stack([np.concatenate([self.meaning(x), whole]) for x in labels]), self.weights["label"]).tolist()

    def count(self, text, tokens, task, fields):
        return h.predicted_count(self.meaning(task), self.weights["count"])

    def instance(self, text, tokens, task, fields, k, scored):
        queries = h.count_queries(np.stack([self.meaning(f) for f in fields]), k + 1, self.weights["instances"])[k]
        return {f: self._hits(x, len(tokens)) for f, x in zip(fields, self._spans(tokens, queries))}

    def content(self, tokens, span):
        return h.pooled(self.states([t[0] for t in tokens]), np.array([span[0]]), np.array([span[1]]))

    def attribute(self, tokens, span, group, label):
        """The score of that very span for the label, whatever the pool of candidates was."""
        content, query = self.content(tokens, span), self.meaning(label)[None]
        return float((query @ content.T / np.sqrt(content.shape[1]) + h.film_match(content, query, self.weights["film"]))[0, 0])

    def pair(self, relation, head, tail, n, tokens=None):
        words = self.states([t[0] for t in tokens]) if tokens is not None else np.zeros((n, self.table.shape[1]))
        return float(h.pair_logits(words, [head], [tail], self.meaning(relation), self.weights["pair"])[0])

    def near(self, structure, anchor, candidate):
        return -abs(anchor[1] - candidate[1]) / 10
