"""Vector arithmetic on array columns: running sums, lookups, quadrature, order statistics.

A spectrum is a short array inside one row, so these expressions run without
a shuffle and stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from fieldgrain.functions.semantics import EPS, col, ratio

Array = Column | str


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times, also inside element-wise lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Array) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Array, b: Array) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def running(values: Array, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """Array of the running fold of ``values``."""
    empty = F.array().cast("array<double>")
    state = F.struct(start.alias("last"), empty.alias("all"))

    def push(acc: Column, x: Column) -> Column:
        now = step(acc["last"], x)
        return F.struct(now.alias("last"), F.concat(acc["all"], F.array(now)).alias("all"))

    return F.aggregate(col(values), state, push, lambda acc: acc["all"])


def running_sum(values: Array) -> Column:
    return running(values, lambda last, x: last + x, F.lit(0.0))


def running_max(values: Array) -> Column:
    return running(values, lambda last, x: F.greatest(last, x), F.lit(float("-inf")))


def scaled(values: Array, divisor: Column) -> Column:
    """Every element over ``divisor``; NULL elements when the divisor is zero."""
    return let(F.when(divisor != 0, divisor), lambda d: F.transform(col(values), lambda x: x / d))


def differences(values: Array) -> Column:
    v = col(values)
    n = F.greatest(F.size(v) - 1, F.lit(0))
    return F.zip_with(F.slice(v, F.lit(2), n), F.slice(v, F.lit(1), n), lambda b, a: b - a)


def midpoints(values: Array) -> Column:
    v = col(values)
    n = F.greatest(F.size(v) - 1, F.lit(0))
    return F.zip_with(F.slice(v, F.lit(2), n), F.slice(v, F.lit(1), n), lambda b, a: (a + b) * 0.5)


def trapezoid(x: Array, y: Array) -> Column:
    return dot(differences(x), midpoints(y))


def at(values: Array, index: Column) -> Column:
    """Element by 0-based index, NULL outside."""
    return F.get(col(values), index)


def argmax(values: Array) -> Column:
    """0-based index of the first maximum."""
    v = col(values)
    return F.array_position(v, F.array_max(v)).cast("int") - 1


def moving_mean(values: Array, before: int, after: int) -> Column:
    """Centred mean with a window that shrinks at both ends."""
    v = col(values)

    def mean_at(_, i: Column) -> Column:
        first = F.greatest(i - before, F.lit(0))
        last = F.least(i + after, F.size(v) - 1)
        return total(F.slice(v, first + 1, last - first + 1)) / (last - first + 1)

    return F.transform(v, mean_at)


def circular_sum(values: Array, window: int) -> Column:
    """Sum over ``window`` neighbouring bins of a circle; the extra bin of an even window lies to the right."""
    v = col(values)
    left, right = (window - 1) // 2, -(-(window - 1) // 2)

    def sum_at(_, i: Column) -> Column:
        out = F.lit(0.0)
        for shift in range(-left, right + 1):
            out = out + F.get(v, F.pmod(i + shift, F.size(v)))
        return out

    return F.transform(v, sum_at)


def array_percentile(values: Array, p: float) -> Column:
    """Midpoint-position percentile of an array."""

    def pick(v: Column) -> Column:
        n = F.size(v)
        rank = F.greatest(F.lit(1.0), F.least(n.cast("double"), n * float(p) + 0.5))
        low = F.floor(rank).cast("int")
        a, b = F.get(v, low - 1), F.get(v, F.ceil(rank).cast("int") - 1)
        return F.when(n > 0, a + (rank - low) * (b - a))

    return let(F.array_sort(col(values)), pick)


def inverse_lookup(ecum: Array, k: Array, q: Column | float) -> Column:
    """Wavenumber where a nondecreasing curve reaches ``q``.

    ``q`` is clamped to the curve's range, and a repeated level counts once,
    at its first wavenumber.
    """
    e, kk = col(ecum), col(k)
    level = q if isinstance(q, Column) else F.lit(float(q))

    def below(limit: Column) -> Column:
        return F.size(F.filter(e, lambda x: x < limit))

    def inside(target: Column, i: Column) -> Column:
        def between(low: Column) -> Column:
            k_low = F.get(kk, below(low))
            return k_low + (target - low) / (F.get(e, i) - low) * (F.get(kk, i) - k_low)

        return let(F.get(e, i - 1), between)

    def solve(target: Column) -> Column:
        return let(
            below(target), lambda i: F.when(F.get(e, i) == target, F.get(kk, i)).otherwise(inside(target, i))
        )

    target = F.greatest(F.array_min(e), F.least(F.array_max(e), level))
    return F.when(F.array_max(e) > F.array_min(e), let(target, solve))


def forward_lookup(k: Array, ecum: Array, target: Column | float) -> Column:
    """Curve value at a wavenumber, extended linearly past both ends, then clamped to [0, 1]."""
    e, kk = col(ecum), col(k)
    wanted = target if isinstance(target, Column) else F.lit(float(target))

    def solve(x: Column) -> Column:
        def value(j: Column) -> Column:
            k0, k1, e0, e1 = F.get(kk, j), F.get(kk, j + 1), F.get(e, j), F.get(e, j + 1)
            return e0 + ratio(x - k0, k1 - k0) * (e1 - e0)

        below = F.size(F.filter(kk, lambda v: v < x))
        return let(F.greatest(F.lit(0), F.least(below - 1, F.size(kk) - 2)), value)

    def clamp(v: Column) -> Column:
        return F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))

    return let(let(wanted, solve), clamp)


def entropy(p: Array, count: Column) -> Column:
    """Shannon entropy over log(count), guarded against log(0)."""
    return -total(F.transform(col(p), lambda x: x * F.log(x + EPS))) / F.log(count.cast("double"))
