"""Scoring arithmetic as Spark columns (arrays of doubles), with numpy twins in ``functions.heads``."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def let(value: Column, use) -> Column:
    """use(value), with value computed once rather than wherever a lambda mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)


def softmax(xs: Column) -> Column:
    raised = let(F.array_max(xs), lambda top: F.transform(xs, lambda x: F.exp(x - top)))
    return let(raised, lambda e: let(total(e), lambda n: F.transform(e, lambda x: x / n)))


def softmax_over(x: Column, *keys: str) -> Column:
    """Softmax of a long table's column within its group."""
    w = Window.partitionBy(*keys)
    raised = F.exp(x - F.max(x).over(w))
    return raised / F.sum(raised).over(w)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def linear(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    bias = bias or [0.0] * len(weights)
    return F.array(*[dot(x, F.array(*map(F.lit, row))) + F.lit(b) for row, b in zip(weights, bias)])


def argmax(xs: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def mean(xs: Column) -> Column:
    return total(xs) / F.greatest(F.size(xs), F.lit(1))


def layernorm(xs: Column, eps: float = 1e-5) -> Column:
    centred = let(mean(xs), lambda m: F.transform(xs, lambda x: x - m))
    scaled = lambda c: let(F.sqrt(mean(F.transform(c, lambda y: y * y)) + eps), lambda d: F.transform(c, lambda x: x / d))
    return let(centred, scaled)


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + erf(x / F.lit(2.0**0.5)))


def length_features(length: Column, total: Column) -> Column:
    return F.array(F.log(1.0 + length), length / total, 1 / F.sqrt(length))


def logit_of(p: Column) -> Column:
    return F.log(p / (1 - p))
