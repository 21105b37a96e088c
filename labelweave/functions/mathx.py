"""Scalar mathematics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def laplace_smooth(estimate: Column, n: Column, t: Column, weight: float = 1.0) -> Column:
    """(e n + w ln(t + 1) / 2) / (n + w ln(t + 1)); one half where there is neither."""
    w = F.lit(weight) * F.log(t + 1)
    return F.when(n + w == 0, F.lit(0.5)).otherwise((estimate * n + w * 0.5) / (n + w))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds of a share; (0, 1) for n = 0."""
    p = ratio(hits.cast("double"), n)
    safe = F.greatest(n, F.lit(1))
    half = z * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe))
    middle, scale = p + z * z / (2 * safe), 1 + z * z / safe
    low, high = (middle - half) / scale, (middle + half) / scale
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), low)), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), high))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def normalised(values: Column) -> Column:
    s = total(values)
    return F.transform(values, lambda x: F.when(s > 0, x / s).otherwise(1.0 / F.size(values)))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    return normalised(F.transform(values, lambda x: F.exp(x - top)))


def entropy(p: Column) -> Column:
    """In nats."""
    return total(F.transform(p, lambda x: F.when(x > 0, -x * F.log(x)).otherwise(0.0)))


def js_divergence(p: Column, q: Column) -> Column:
    def part(a: Column, b: Column) -> Column:
        return total(F.zip_with(a, b, lambda x, y: F.when(x > 0, x * F.log(x / ((x + y) / 2))).otherwise(0.0)))

    return (part(p, q) + part(q, p)) / 2


def margin(p: Column) -> Column:
    """Largest less second largest."""
    s = F.sort_array(p, asc=False)
    return F.when(F.size(p) > 1, F.element_at(s, 1) - F.element_at(s, 2)).otherwise(F.element_at(s, 1))
