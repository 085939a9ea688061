"""Numeric heads in numpy: what a scorer with weights computes for one document or batch.

Arrays are float64; states are (places, width). Weights are dictionaries of arrays by name.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def softmax(x, axis=-1):
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def linear(x, w, b=None):
    return x @ w.T if b is None else x @ w.T + b


def layernorm(x, scale=1.0, shift=0.0, eps=1e-5):
    m = x.mean(axis=-1, keepdims=True)
    return (x - m) / np.sqrt(((x - m) ** 2).mean(axis=-1, keepdims=True) + eps) * scale + shift


def erf(x):
    t = 1 / (1 + 0.3275911 * np.abs(x))
    return np.sign(x) * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * np.exp(-x * x))


def gelu(x):
    return 0.5 * x * (1 + erf(x / np.sqrt(2)))


def relu(x):
    return np.maximum(x, 0)


def swiglu(x, gate, up, down):
    g = linear(x, gate)
    return linear(g * sigmoid(g) * linear(x, up), down)


def rotary(x, base=10000.0):
    """Rotates halves of each state by angles that grow with its place."""
    n, d = x.shape
    angle = np.arange(n)[:, None] / base ** (np.arange(0, d, 2) / d)
    a, b = x[:, : d // 2], x[:, d // 2 :]
    return np.concatenate([a * np.cos(angle) - b * np.sin(angle), b * np.cos(angle) + a * np.sin(angle)], axis=1)


def attention(q, k, v, heads: int, reach: int | None = None):
    """Multi-head attention; with ``reach`` places further apart do not see each other."""
    n, d = q.shape
    split = lambda x: x.reshape(len(x), heads, d // heads).transpose(1, 0, 2)
    s = split(q) @ split(k).transpose(0, 2, 1) / np.sqrt(d // heads)
    if reach is not None:
        far = np.abs(np.arange(n)[:, None] - np.arange(len(k))[None]) > reach
        s = np.where(far[None], -1e30, s)
    return (softmax(s) @ split(v)).transpose(1, 0, 2).reshape(n, d)


def transformer_layer(x, w, heads: int, reach: int | None = None):
    a = attention(linear(x, w["q"]), linear(x, w["k"]), linear(x, w["v"]), heads, reach)
    x = layernorm(x + linear(a, w["o"]))
    return layernorm(x + linear(gelu(linear(x, w["up"])), w["down"]))


def gru_step(x, h, w):
    """One step of a gated recurrent unit."""
    xr, xz, xn = np.split(linear(x, w["input"], w.get("input_bias")), 3, axis=-1)
    hr, hz, hn = np.split(linear(h, w["hidden"], w.get("hidden_bias")), 3, axis=-1)
    r, z = sigmoid(xr + hr), sigmoid(xz + hz)
    return (1 - z) * np.tanh(xn + r * hn) + z * h


def count_queries(queries, count: int, w):
    """Query states for each of ``count`` instances: a recurrent step an instance, then a small network on both."""
    h, out = queries, []
    for i in range(count):
        h = gru_step(np.broadcast_to(w["places"][i], queries.shape), h, w)
        out.append(linear(relu(linear(np.concatenate([h, queries], axis=-1), w["up"])), w["down"]))
    return np.stack(out) if out else np.zeros((0, *queries.shape))


def mlp(x, first, second):
    return linear(relu(linear(x, *first)), *second)


def span_states(states, width: int, w):
    """(places, width, d): a state for every span, from those of its first and last word."""
    start, end = mlp(states, *w["start"]), mlp(states, *w["end"])
    n = len(states)
    last = np.minimum(np.arange(n)[:, None] + np.arange(width)[None], n - 1)
    both = np.concatenate([np.broadcast_to(start[:, None], (n, width, start.shape[1])), end[last]], axis=-1)
    return mlp(relu(both), *w["out"])


def span_scores(spans, queries):
    return np.einsum("nwd,qd->qnw", spans, queries)


def predicted_count(x, w) -> int:
    return int(np.argmax(mlp(x, *w)))


def marginals(places, queries):
    """(queries, places) dot products by root of width."""
    return queries @ places.T / np.sqrt(places.shape[1])


def inside_prefix(inside):
    """(mean of each query, prefix sums of centred scores)."""
    m = inside.mean(axis=1, keepdims=True) if inside.shape[1] else np.zeros((len(inside), 1))
    return m, np.concatenate([np.zeros((len(inside), 1)), np.cumsum(inside - m, axis=1)], axis=1)


def pooled(values, starts, ends):
    """Mean of each span's values, normalised."""
    sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return layernorm((sums[ends] - sums[starts]) / np.maximum(ends - starts, 1)[:, None])


def candidate_logits(content, queries, film, start, end, inside, starts, ends):
    """(queries, candidates): content match, conditioned match, ends and inside by root of length."""
    length = np.maximum(ends - starts, 1)
    m, prefix = inside_prefix(inside)
    within = (prefix[:, ends] - prefix[:, starts] + m * length) / np.sqrt(length)
    return queries @ content.T / np.sqrt(content.shape[1]) + film + start[:, starts] + end[:, ends] + within


def film_match(content, queries, w):
    """Queries scale and shift the content before a small network scores it."""
    scale, shift = linear(queries, w["scale"]), linear(queries, w["shift"])
    mixed = content[None] * (1 + scale[:, None]) + shift[:, None]
    return mlp(mixed, w["first"], w["second"])[..., 0]


def pair_logits(words, heads, tails, query, w):
    """Relation score of (head, tail) spans: states of their ends, query, order and distance; a gated bilinear and a linear part."""
    n = max(len(words), 1)
    h, t = np.array(heads).reshape(-1, 2), np.array(tails).reshape(-1, 2)
    gap = (t[:, 0] - h[:, 0]).astype(float)
    far = np.stack([np.sign(gap), np.abs(gap) / n], axis=1)
    parts = [words[h[:, 0]], words[h[:, 1] - 1], words[t[:, 0]], words[t[:, 1] - 1]]
    x = np.concatenate([*parts, np.broadcast_to(query, (len(h), len(query))), far], axis=1)
    mean = lambda s: np.stack([words[a:b].mean(axis=0) for a, b in s]) if len(s) else np.zeros((0, words.shape[1]))
    hm, tm = mean(h), mean(t)
    bilinear = np.einsum("nd,de,ne->n", hm, w["bilinear"], tm) * sigmoid(float(query @ w["gate"]))
    return mlp(x, w["first"], w["second"])[:, 0] + bilinear + np.concatenate([hm, tm], axis=1) @ w["linear"]


def class_logits(labels, w):
    return mlp(labels, *w)[..., 0]


def gather(states, places):
    """Rows of states; zeros where a place is missing."""
    out = np.zeros((len(places), states.shape[1]))
    ok = np.array([p is not None and 0 <= p < len(states) for p in places], dtype=bool)
    out[ok] = states[[p for p, k in zip(places, ok) if k]]
    return out
