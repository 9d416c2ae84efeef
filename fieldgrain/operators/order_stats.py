"""Exact order statistics that never sort a whole group in one task.

A plain ``row_number() over (partition by group order by value)`` sends every
row of a group to one task. Here rows are first collapsed to distinct values
with counts (map-side combine). Values then fall into cells by rounding doubles
to 16 and other numbers to 20 significant bits, which keeps their order: a
running sum is "sums of earlier cells" plus the running sum inside the cell. A
group has at most 2^15 (2^19) cells per power of two that its values span, so
their number stops growing with the rows. Values in a band narrower than 2^-16
(2^-20) of their size share a cell; ``bits=(12, 32)`` cuts those in two levels.
Percentiles read the
cells' counts first and then only the few cells that hold a wanted rank. The plan is the same for small and large groups, any number of rows is
cut by the same rule, and nothing is computed while the plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgrain.functions.semantics import hash_text, null_safe_join

#: Significant bits of the cells of a double and of another number; letters of the prefixes of a text.
DOUBLE_BITS = (16,)
VALUE_BITS = (20,)
TEXT_LETTERS = (2, 8)
#: Significant bits of the cells that percentiles count before they read values.
RANK_BITS = 12
#: Hexadecimal digits of a hash that name its cell: 2^20 cells.
HASH_DIGITS = (5,)


def rounded_bits(value: Column, bits: int) -> Column:
    """A double rounded to so many significant bits, by splitting: never decreasing in the value."""
    small = F.when(F.abs(value) > 2.0**900, value * 2.0**-100).otherwise(value)
    c = small * float(2 ** (53 - bits) + 1)
    high = c - (c - small)
    high = F.when(F.abs(value) > 2.0**900, high * 2.0**100).otherwise(high)
    return F.when(F.abs(value) == float("inf"), value).otherwise(high)


def value_cells(df: DataFrame, value: str, bits: Sequence[int] | None = None) -> list[Column]:
    """Cells of a value from coarse to fine, each a function of the next, in the order of the values."""
    kind = df.schema[value].dataType.simpleString()
    v = F.col(value)
    if kind == "string":
        return [F.substring(v, 1, n) for n in TEXT_LETTERS]
    number = F.unix_date(v) if kind == "date" else F.unix_micros(v) if kind == "timestamp" else v
    cells: list[Column] = []
    for b in sorted(bits or (DOUBLE_BITS if kind in ("double", "float") else VALUE_BITS), reverse=True):
        cells.insert(0, rounded_bits(cells[0] if cells else number.cast("double"), b))
    return cells


def sums_before(
    df: DataFrame, by: Sequence[str], cells: Sequence[str], sums: Sequence[str], *, descending: bool = False
) -> DataFrame:
    """One row per (by, cells): ``_b_<sum>`` over the earlier cells of the group and ``_t_<sum>`` over the whole group."""
    order = F.col(cells[-1]).desc() if descending else F.col(cells[-1]).asc()
    total = df.groupBy(*by, *cells).agg(*[F.sum(s).alias(s) for s in sums])
    around = [*by, *cells[:-1]]
    earlier = Window.partitionBy(*around).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = {s: F.coalesce(F.sum(s).over(earlier), F.lit(0)) for s in sums}
    if len(cells) == 1:
        whole = {s: F.sum(s).over(Window.partitionBy(*by)) for s in sums}
        return total.select(*by, *cells, *[c.alias(f"_b_{s}") for s, c in before.items()], *[c.alias(f"_t_{s}") for s, c in whole.items()])
    inside = total.select(*by, *cells, *[c.alias(f"_i_{s}") for s, c in before.items()])
    above = sums_before(total, by, cells[:-1], sums, descending=descending)
    return null_safe_join(inside, above, around).select(
        *by, *cells, *[(F.col(f"_b_{s}") + F.col(f"_i_{s}")).alias(f"_b_{s}") for s in sums], *[f"_t_{s}" for s in sums]
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column] | None = None,
    *,
    descending: bool = False,
    bits: Sequence[int] | None = None,
) -> DataFrame:
    """One row per distinct value of a group, with running and total sums in value order.

    ``sums`` maps an output name to an aggregate; each gives ``name``,
    ``name_upto`` (this value included) and ``name_total``. Without ``sums``
    the row count ``n`` is used. NULL values are left out; NaN comes last.
    """
    sums = dict(sums or {"n": F.count(F.lit(1))})
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    if not keys:
        rows = rows.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    atoms = rows.groupBy(*by, value).agg(*[agg.alias(name) for name, agg in sums.items()])
    levels = value_cells(atoms, value, bits)
    cells = [f"_cell{i}" for i in range(len(levels))]
    atoms = atoms.select("*", *[c.alias(n) for c, n in zip(levels, cells)])
    # A cell's sums so far are one more row, which comes first in the cell: atoms are not joined to them.
    missing = F.lit(None).cast(atoms.schema[value].dataType)
    heads = sums_before(atoms, by, cells, list(sums), descending=descending).withColumn(value, missing)
    order = F.col(value).desc_nulls_first() if descending else F.col(value).asc_nulls_first()
    inside = Window.partitionBy(*by, *cells).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = atoms.unionByName(heads, allowMissingColumns=True).select(
        *by,
        value,
        *sums,
        *[F.sum(F.coalesce(F.col(f"_b_{s}"), F.col(s))).over(inside).alias(f"{s}_upto") for s in sums],
        *[F.first(f"_t_{s}").over(inside).alias(f"{s}_total") for s in sums],
    )
    out = out.where(F.col(value).isNotNull())
    return out if keys else out.drop("_all")


def _at_rank(value: str, rank: Column) -> Column:
    inside = (F.col("n_upto") - F.col("n") < rank) & (rank <= F.col("n_upto"))
    return F.max(F.when(inside, F.col(value)))


def percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], *, bits: Sequence[int] = (32,),
    few_groups: bool = False,
) -> DataFrame:
    """Exact percentiles with midpoint plotting positions: rank p*n + 0.5, linear between, clamped at the ends.

    Two passes over the rows and no shuffle of them all: cells of 12 significant bits are counted with map-side sums,
    then only rows in cells that hold a wanted rank are ranked. NULL values are left out. ``few_groups`` says that the
    caller bounds the number of groups (one without keys): the wanted cells, two a rank and group, are then broadcast.
    """
    by = list(keys) or ["_all"]
    value_ = F.col(value).cast("double").alias("_v")
    rows = df.select(*(keys or [F.lit(0).alias("_all")]), value_).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_cell", rounded_bits(F.col("_v"), RANK_BITS))
    counts = rows.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    upto = F.sum("_n").over(whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.select("*", (upto - F.col("_n")).alias("_start"), F.sum("_n").over(whole).alias("_size"))
    ranks = {}
    for name, p in probabilities.items():
        n = F.col("_size").cast("double")
        ranks[name] = F.greatest(F.lit(1.0), F.least(n, F.col("_size") * float(p) + 0.5))
    ends = F.array(*[end(r) for r in ranks.values() for end in (F.floor, F.ceil)])
    wanted = placed.where(F.exists(ends, lambda r: (F.col("_start") < r) & (r <= F.col("_start") + F.col("_n")))).drop("_n")
    if few_groups or not keys:
        wanted = F.broadcast(wanted)
    # with many groups Spark's own size check decides on broadcast
    near = null_safe_join(rows, wanted, [*by, "_cell"])
    atoms = running_totals(near, [*by, "_cell", "_start", "_size"], "_v", bits=bits)
    atoms = atoms.withColumn("n_upto", F.col("_start") + F.col("n_upto"))
    aggs, outs = [], []
    for name, rank in ranks.items():
        low = F.floor(rank)
        aggs += [
            _at_rank("_v", low).alias(f"_l_{name}"),
            _at_rank("_v", F.ceil(rank)).alias(f"_h_{name}"),
            F.max(rank - low).alias(f"_w_{name}"),
        ]
        outs.append(
            (F.col(f"_l_{name}") + F.col(f"_w_{name}") * (F.col(f"_h_{name}") - F.col(f"_l_{name}"))).alias(name)
        )
    return atoms.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def hash_positions(
    df: DataFrame, keys: Sequence[str], item: Sequence[str], seed: int | str, *, digits: Sequence[int] = HASH_DIGITS
) -> DataFrame:
    """Random order without one big sort: position of each row by seeded md5 inside its group.

    Hashes are uniform, so prefixes of the hash cut the rows into 2^20 cells of
    like size, and only the rows of a cell are sorted together.
    Adds ``position`` (from 1) and ``group_size``.
    """
    by = list(keys)
    base = df if by else df.withColumn("_all", F.lit(0))
    by = by or ["_all"]
    cells = [f"_cell{n}" for n in digits]
    hashed = base.withColumn("_h", hash_text(seed, *item)).withColumns({c: F.substring("_h", 1, n) for c, n in zip(cells, digits)})
    counts = hashed.groupBy(*by, *cells).agg(F.count(F.lit(1)).alias("n"))
    offsets = sums_before(counts, by, cells, ["n"]).withColumnRenamed("_t_n", "group_size")
    local = hashed.withColumn("_rn", F.row_number().over(Window.partitionBy(*by, *cells).orderBy("_h", *item)))
    out = null_safe_join(local, offsets, [*by, *cells]).withColumn("position", F.col("_b_n") + F.col("_rn"))
    return out.drop("_h", "_rn", "_b_n", "_all", *cells)


def row_positions(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: Sequence[str],
    *,
    descending: bool = False,
    seed: int | str = 0,
    bits: Sequence[int] | None = None,
) -> DataFrame:
    """Position of every row by value, equal values ordered by seeded md5 of ``tie``.

    Adds ``position`` and ``group_size``; rows with a NULL value are left out.
    """
    keys = list(keys)
    atoms = running_totals(df, keys, value, descending=descending, bits=bits).select(
        *keys, value, (F.col("n_upto") - F.col("n")).alias("_start"), F.col("n_total").alias("_total")
    )
    ranked = hash_positions(df.where(F.col(value).isNotNull()), [*keys, value], tie, seed).withColumnRenamed(
        "position", "_within"
    )
    return (
        null_safe_join(ranked.drop("group_size"), atoms, [*keys, value])
        .withColumn("position", F.col("_start") + F.col("_within"))
        .withColumnRenamed("_total", "group_size")
        .drop("_start", "_within")
    )


#: Hexadecimal digits for the rows of a value that a bin's limit divides.
DIVIDED_DIGITS = (3,)


def equal_count_bins(
    df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str], bins: int, out: str, *, seed: int | str = 0,
    few_groups: bool = False,
) -> DataFrame:
    """Add the equal-count bin (from 1) that :func:`row_positions` puts a row in; rows with a NULL value are left out.

    A value whose rows all fall into one bin needs no order among them. Only the rows of values that a limit divides, at
    most one a limit and group, are put in hash order. ``few_groups``: the caller bounds the number of groups, whose
    limits are then broadcast.
    """
    keys = list(keys)
    atoms = running_totals(df, keys, value)
    used = F.least(F.lit(bins), F.col("n_total"))
    number = lambda position: F.ceil(position * used / F.col("n_total"))
    start = F.col("n_upto") - F.col("n")
    last = number(F.col("n_upto"))
    # a value's last rows are in bin b or later exactly if no smaller value begins b: limits are the first such values
    limits = [F.min(F.when(last >= b, F.col(value))).alias(f"_l{b}") for b in range(1, bins + 1)]
    divided = [F.max(F.when((number(start + 1) < b) & (last >= b), start)).alias(f"_s{b}") for b in range(2, bins + 1)]
    facts = atoms.groupBy(*keys).agg(*limits, *divided, F.max("n_total").alias("n_total"))
    facts = F.broadcast(facts) if few_groups or not keys else facts
    rows = df.where(F.col(value).isNotNull())
    rows = null_safe_join(rows, facts, keys) if keys else rows.crossJoin(facts)
    mine = F.coalesce(*[F.when(F.col(value) == F.col(f"_l{b}"), F.col(f"_s{b}")) for b in range(2, bins + 1)], F.lit(None))
    rows = rows.withColumn("_start", mine)
    below = sum((F.when(F.col(f"_l{b}") <= F.col(value), 1).otherwise(0) for b in range(1, bins + 1)), F.lit(0))
    whole = rows.where(F.col("_start").isNull()).withColumn(out, below)
    parted = rows.where(F.col("_start").isNotNull()).select(*df.columns, "_start", "n_total")
    ranked = hash_positions(parted, [*keys, value], tie, seed, digits=DIVIDED_DIGITS)
    placed = ranked.withColumn(out, number(F.col("_start") + F.col("position")).cast("int"))
    return whole.select(*df.columns, out).unionByName(placed.select(*df.columns, out))
