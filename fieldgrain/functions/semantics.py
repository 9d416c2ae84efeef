"""Column rules shared by all operators: missing values, bins, labels, hashes, clipping."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: the double-precision unit roundoff used as a guard in logs and divisions.
EPS = 2.220446049250313e-16

OUT_OF_RANGE = "out_of_range"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Column | str) -> Column:
    """Missing means not finite: NaN and both infinities become NULL."""
    value = col(c).cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def finite_columns(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Apply :func:`finite` to the floating columns of a frame in one projection."""
    names = set(columns or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")])
    return df.select(*[finite(c).alias(c) if c in names else F.col(c) for c in df.columns])


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL for a zero or missing denominator in ANSI and legacy mode alike."""
    return num.cast("double") / F.when(den != 0, den.cast("double"))


def clip(c: Column | str, low: float, high: float) -> Column:
    value = col(c)
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def share(condition: Column) -> Column:
    """Mean of a predicate; NULL predicates are left out."""
    return F.avg(condition.cast("double"))


def percent(condition: Column) -> Column:
    return F.lit(100.0) * share(condition)


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {', '.join(missing)}")


def check_edges(edges: Sequence[float], name: str) -> list[float]:
    values = [float(e) for e in edges]
    if len(values) < 2 or any(b <= a for a, b in zip(values, values[1:])) or any(
        e != e or abs(e) == float("inf") for e in values
    ):
        raise ValueError(f"{name} edges must be at least two finite increasing values")
    return values


def bin_index(c: Column | str, edges: Sequence[float]) -> Column:
    """1-based bin; left-closed, right-open, last bin closed on both sides; 0 outside or missing."""
    value = col(c).cast("double")
    last = len(edges) - 2
    out = F.when(value.isNull() | F.isnan(value), F.lit(0))
    for i in range(last + 1):
        below = value <= edges[i + 1] if i == last else value < edges[i + 1]
        out = out.when((value >= edges[i]) & below, F.lit(i + 1))
    return out.otherwise(F.lit(0)).cast("int")


def bin_label(index: Column | str, edges: Sequence[float]) -> Column:
    """Interval text of a bin index."""
    index = col(index)
    last = len(edges) - 2
    out = F.when(index <= 0, F.lit(OUT_OF_RANGE))
    for i in range(last + 1):
        text = f"[{edges[i]:g},{edges[i + 1]:g}{']' if i == last else ')'}"
        out = out.when(index == i + 1, F.lit(text))
    return out


def pair_index(dx: Column | str, dz: Column | str, pairs: Sequence[tuple[float, float]], tolerance: float) -> Column:
    """1-based index of the tolerance-matched (dx, dz) pair; a later pair wins; 0 without match."""
    out = None
    for i in range(len(pairs) - 1, -1, -1):
        hit = (F.abs(col(dx) - F.lit(float(pairs[i][0]))) <= tolerance) & (
            F.abs(col(dz) - F.lit(float(pairs[i][1]))) <= tolerance
        )
        out = F.when(hit, F.lit(i + 1)) if out is None else out.when(hit, F.lit(i + 1))
    return out.otherwise(F.lit(0)).cast("int")


def pair_label(index: Column | str, pairs: Sequence[tuple[float, float]]) -> Column:
    index = col(index)
    out = F.when(index <= 0, F.lit(OUT_OF_RANGE))
    for i, (dx, dz) in enumerate(pairs):
        out = out.when(index == i + 1, F.lit(f"dx={dx:g},dz={dz:g}"))
    return out


def hash_text(seed: int | str, *parts: Column | str) -> Column:
    """Seeded order key: md5 of ``seed:part:...``, the same on any partitioning and in any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts]))


def named(text: Column) -> Column:
    """Value of a text column, or NULL when it is empty (distinct counts ignore empty names)."""
    return F.when(text != "", text)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys and keeps the left key columns."""
    if not keys:
        raise ValueError("a join needs keys")
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        condition = test if condition is None else condition & test
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def steady_mean(value: str) -> Column:
    """Mean that is the same in every reading of the table: a sum of doubles changes in its last digit with the order of
    the rows. Values are summed as decimals of 15 places; where one has no such decimal (NaN, infinite, over 10^13) the
    plain mean stands."""
    exact = F.try_divide(F.sum(as_decimal := F.col(value).try_cast("decimal(28,15)")).cast("double"), F.count(value))
    return F.when(F.count(as_decimal) == F.count(value), exact).otherwise(F.avg(value))


def steady_sum(value: Column | str) -> Column:
    """Sum of doubles that is the same in every order of the rows, so that equal sets of rows have equal sums.

    Whole 2^-24ths and, of what is left, whole 2^-56ths are summed as integers; a value's part below 2^-56 is left out.
    Where a value is not finite or over 2^38, or the integers overflow, the plain sum stands."""
    x = col(value).cast("double")
    fits = F.abs(x) < 2.0**38
    scaled = F.when(fits, x * 2.0**24)
    units = scaled.try_cast("long")
    rest = ((scaled - units) * 2.0**32).try_cast("long")
    exact = (F.try_sum(units).cast("double") + F.try_sum(rest).cast("double") / 2.0**32) / 2.0**24
    return F.when(F.count(units) == F.count(x), F.coalesce(exact, F.sum(x))).otherwise(F.sum(x))
