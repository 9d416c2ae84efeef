"""Grid maps as long tables (map_id, iz, ix, value, ...): neighbourhoods, distances, filling, smoothing.

Neighbourhood operators scatter each cell to the positions that need it and
gather by position in one grouped sum: keys are single cells, so a map of any
size spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldgrain.functions.semantics import null_safe_join
from fieldgrain.operators.metrics import weighted_median
from fieldgrain.operators.order_stats import percentiles, running_totals
from fieldgrain.session import cut_lineage

CELL = ["map_id", "iz", "ix"]


def square(radius: int) -> list[tuple[int, int]]:
    return [(z, x) for z in range(-radius, radius + 1) for x in range(-radius, radius + 1)]


CROSS = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]


def scattered(cells: DataFrame, offsets: Iterable[tuple[int, int]], columns: Sequence[str]) -> DataFrame:
    """Rows (map_id, iz, ix, oz, ox, columns): the neighbour at offset (oz, ox) of position (iz, ix)."""
    steps = F.array(*[F.struct(F.lit(z).alias("oz"), F.lit(x).alias("ox")) for z, x in offsets])
    out = cells.select("map_id", F.col("iz").alias("_z"), F.col("ix").alias("_x"), *columns, F.explode(steps).alias("_o"))
    return out.select(
        "map_id", (F.col("_z") - F.col("_o.oz")).alias("iz"), (F.col("_x") - F.col("_o.ox")).alias("ix"),
        F.col("_o.oz").alias("oz"), F.col("_o.ox").alias("ox"), *columns,
    )


def gather(cells: DataFrame, offsets: Iterable[tuple[int, int]], columns: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregate over the neighbours of every existing cell; offset (0, 0) marks the cell itself."""
    own = (F.col("oz") == 0) & (F.col("ox") == 0)
    grouped = scattered(cells, offsets, columns).groupBy(*CELL).agg(F.max(own).alias("_own"), *aggs)
    return grouped.where("_own").drop("_own")


def neighbour(value: str, oz: int, ox: int) -> Column:
    return F.max(F.when((F.col("oz") == oz) & (F.col("ox") == ox), F.col(value)))


def completed(cells: DataFrame, value: str = "value") -> DataFrame:
    """Full bounding grid of every map; missing cells get the map's median and ``present`` false."""
    box = cells.groupBy("map_id").agg(*[f(c).alias(f"_{n}{c}") for c in ("iz", "ix") for n, f in (("lo", F.min), ("hi", F.max))])
    grid = box.withColumn("iz", F.explode(F.sequence("_loiz", "_hiiz"))).withColumn("ix", F.explode(F.sequence("_loix", "_hiix")))
    median = percentiles(cells, ["map_id"], value, {"_median": 0.5})
    joined = grid.select(*CELL).join(cells.select(*CELL, value), CELL, "left").join(median, "map_id", "left")
    return joined.select(
        *CELL, F.coalesce(value, "_median", F.lit(0.0)).alias(value), F.col(value).isNotNull().alias("present")
    )


def gradient(cells: DataFrame, value: str = "value") -> DataFrame:
    """Gradient magnitude: central inside, one-sided at the border, after median filling of holes."""
    full = completed(cells, value)
    g = gather(
        full, CROSS, [value, "present"],
        [
            neighbour(value, 0, 0).alias("_c"), neighbour(value, 0, 1).alias("_r"), neighbour(value, 0, -1).alias("_l"),
            neighbour(value, 1, 0).alias("_d"), neighbour(value, -1, 0).alias("_u"), neighbour("present", 0, 0).alias("_p"),
        ],
    )

    def slope(after: str, before: str) -> Column:
        a, b, c = F.col(after), F.col(before), F.col("_c")
        return (
            F.when(a.isNotNull() & b.isNotNull(), (a - b) / 2.0).when(a.isNotNull(), a - c).when(b.isNotNull(), c - b).otherwise(0.0)
        )

    return g.where("_p").select(*CELL, F.hypot(slope("_r", "_l"), slope("_d", "_u")).alias("gradient"))


def local_spread(cells: DataFrame, value: str = "value", radius: int = 1) -> DataFrame:
    """Population spread and range over the present cells of a square neighbourhood."""
    mean, square_mean = F.avg(value), F.avg(F.col(value) * F.col(value))
    return gather(
        cells, square(radius), [value],
        [
            F.count(value).alias("neighbour_count"),
            F.sqrt(F.greatest(square_mean - mean * mean, F.lit(0.0))).alias("local_std"),
            (F.max(value) - F.min(value)).alias("local_range"),
        ],
    )


def boundary(cells: DataFrame, material: str = "material_id") -> DataFrame:
    """Cells with a direct neighbour of another material."""
    rows = gather(
        cells, CROSS, [material],
        [neighbour(material, 0, 0).alias(material), F.min(material).alias("_lo"), F.max(material).alias("_hi")],
    )
    return rows.select(*CELL, material, (F.col("_lo") != F.col("_hi")).alias("is_boundary"))


def nearest(targets: DataFrame, donors: DataFrame, keys: Sequence[str], columns: Sequence[str], *, start: int = 2) -> DataFrame:
    """Exact nearest donor of every target inside its group, by growing search radius.

    Both sides meet on square buckets of the radius (the donor lists the 3 x 3
    buckets around it), so the join is by equality. A target is settled once
    its best donor is within the radius; the others go on with twice the
    radius. Ties go to the smallest (iz, ix). Targets of groups without donors
    get NULLs.
    """
    keys = list(keys)
    have = donors.select(*keys).distinct()
    left = targets.select(*keys, "iz", "ix")
    pending = cut_lineage(left.join(have, keys, "left_semi"))
    done, radius = [], start
    side = donors.select(*keys, F.col("iz").alias("_dz"), F.col("ix").alias("_dx"), *columns)
    while not pending.isEmpty():
        def bucket(c: str) -> Column:
            return F.floor(F.col(c) / radius)

        around = side.withColumn("_bz", F.explode(F.array(*[bucket("_dz") + s for s in (-1, 0, 1)]))).withColumn(
            "_bx", F.explode(F.array(*[bucket("_dx") + s for s in (-1, 0, 1)]))
        )
        asked = pending.withColumn("_bz", bucket("iz")).withColumn("_bx", bucket("ix"))
        pairs = asked.join(around, [*keys, "_bz", "_bx"])
        d2 = (F.col("iz") - F.col("_dz")) ** 2 + (F.col("ix") - F.col("_dx")) ** 2
        best = pairs.groupBy(*keys, "iz", "ix").agg(F.min(F.struct(d2.alias("d2"), "_dz", "_dx", *columns)).alias("_b"))
        settled = cut_lineage(best.where(F.col("_b.d2") <= radius * radius))
        done.append(settled)
        pending = cut_lineage(pending.join(settled.select(*keys, "iz", "ix"), [*keys, "iz", "ix"], "left_anti"))
        radius *= 2
    schema_only = left.limit(0).select(
        *keys, "iz", "ix", F.lit(None).cast("double").alias("distance"), F.lit(None).cast("int").alias("donor_iz"),
        F.lit(None).cast("int").alias("donor_ix"),
    )
    if not done:
        return left.join(schema_only, [*keys, "iz", "ix"], "left")
    found = reduce(DataFrame.unionByName, done).select(
        *keys, "iz", "ix", F.sqrt("_b.d2").alias("distance"), F.col("_b._dz").alias("donor_iz"), F.col("_b._dx").alias("donor_ix"),
        *[F.col(f"_b.{c}").alias(f"donor_{c}") for c in columns],
    )
    return left.join(found, [*keys, "iz", "ix"], "left")


def boundary_distance(cells: DataFrame, material: str = "material_id", spacing_mm: float = 1.0) -> DataFrame:
    """Distance of every cell to the nearest boundary cell of its map (NULL where there is none)."""
    marked = boundary(cells, material)
    found = nearest(marked, marked.where("is_boundary"), ["map_id"], [])
    return found.select(*CELL, (F.col("distance") * spacing_mm).alias("distance_mm"))


def tolerance_join(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float) -> DataFrame:
    """Nearest right point of every left point within a tolerance per axis, in physical coordinates (x, z).

    Points meet on buckets one tolerance wide; the left side asks the 3 x 3
    buckets around it. Ties go to the smallest (z, x).
    """
    def bucket(c: str) -> Column:
        return F.floor(F.col(c) / tolerance)

    asked = left.withColumn("_bx", F.explode(F.array(*[bucket("x") + s for s in (-1, 0, 1)]))).withColumn(
        "_bz", F.explode(F.array(*[bucket("z") + s for s in (-1, 0, 1)]))
    )
    near = right.select(
        *keys, F.col("x").alias("_rx"), F.col("z").alias("_rz"), *[F.col(c).alias(f"near_{c}") for c in columns],
        bucket("x").alias("_bx"), bucket("z").alias("_bz"),
    )
    pairs = asked.join(near, [*keys, "_bx", "_bz"])
    dx, dz = F.abs(F.col("x") - F.col("_rx")), F.abs(F.col("z") - F.col("_rz"))
    close = pairs.where((dx <= tolerance) & (dz <= tolerance))
    best = F.min(F.struct(F.hypot(dx, dz).alias("d"), "_rz", "_rx", *[f"near_{c}" for c in columns]))
    return close.groupBy(*left.columns).agg(best.alias("_b")).select(
        *left.columns, F.col("_b.d").alias("distance"), *[F.col(f"_b.near_{c}").alias(f"near_{c}") for c in columns]
    )


def box_regions(points: DataFrame, boxes: Sequence[tuple[str, float, float, float, float]]) -> DataFrame:
    """Rows of every named box (name, x0, x1, z0, z1) that contains the point; boxes are a parameter list."""
    names = [
        F.when((F.col("x") >= x0) & (F.col("x") <= x1) & (F.col("z") >= z0) & (F.col("z") <= z1), F.lit(n)) for n, x0, x1, z0, z1 in boxes
    ]
    return points.withColumn("roi", F.explode(F.array_compact(F.array(*names))))


def circle_roi(x: Column, z: Column, cx: float, cz: float, radius: float, margin_cap: float = 3.0, margin_share: float = 0.25) -> Column:
    """Core, background, or the excluded ring around a circular boundary."""
    margin = min(margin_cap, margin_share * radius)
    d = F.hypot(x - cx, z - cz)
    return F.when(d <= radius - margin, "inclusion_core").when(d >= radius + margin, "background").otherwise("excluded")


def roi_class(patches: DataFrame, keys: Sequence[str], *, geometry: str = "geometry", material: str = "material_id",
              purity: str = "purity") -> DataFrame:
    """Interface band where the window is mixed, else core or background by geometry and smallest material id."""
    base = patches.groupBy(*keys).agg(F.min(material).alias("_base"))
    rows = null_safe_join(patches, base, keys, "left")
    background = F.col(material) == F.col("_base")
    label = (
        F.when(F.col(purity) < 1 - 1e-12, "interface_band")
        .when((F.col(geometry) == "inclusion") & background, "background_far")
        .when(F.col(geometry) == "inclusion", "inclusion_core")
        .when((F.col(geometry) == "bilayer") & background, "layer_1_core")
        .when(F.col(geometry) == "bilayer", "layer_2_core")
        .otherwise("homogeneous")
    )
    return rows.withColumn("roi", label).drop("_base")


def map_grid(points: DataFrame, keys: Sequence[str], x: str, z: str) -> DataFrame:
    """Grid indices of physical centres: dense rank of the distinct coordinates of each map (a grid's width)."""
    def axis(c: str, out: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(c)
        return points.select(*keys, c).distinct().withColumn(out, F.row_number().over(w))

    return points.join(axis(x, "map_ix"), [*keys, x]).join(axis(z, "map_iz"), [*keys, z])


def grid_checks(indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, grid size, duplicates and completeness of every map."""
    cells = indexed.groupBy(*keys, "map_iz", "map_ix").agg(F.count(F.lit(1)).alias("_n"))
    return cells.groupBy(*keys).agg(
        F.sum("_n").alias("row_count"),
        (F.max("map_iz") * F.max("map_ix")).cast("long").alias("grid_size"),
        F.count_if(F.col("_n") > 1).alias("duplicate_cells"),
        (F.count(F.lit(1)) == F.max("map_iz") * F.max("map_ix")).alias("complete"),
    )


def map_rows(indexed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Dense map lines: one array per grid row, ordered by column."""
    line = F.array_sort(F.collect_list(F.struct("map_ix", value)))
    return indexed.groupBy(*keys, "map_iz").agg(F.transform(line, lambda c: c[value]).alias("line"))


def upsample(cells: DataFrame, factor: int, value: str = "value", method: str = "linear") -> DataFrame:
    """Query points ``factor`` times denser between present cells, bilinear or nearest.

    Each cell gathers its right, lower and diagonal neighbour once and emits
    the points of its own square; a point needs every corner that carries weight.
    """
    if method not in ("linear", "nearest"):
        raise ValueError("method must be linear or nearest")
    corners = {(0, 0): "_a", (0, 1): "_b", (1, 0): "_c", (1, 1): "_d"}
    g = gather(cells, list(corners), [value], [neighbour(value, *o).alias(n) for o, n in corners.items()])
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    points = g.withColumn("fz", F.explode(steps)).withColumn("fx", F.explode(steps))
    wx, wz = F.col("fx") / factor, F.col("fz") / factor
    need_b, need_c = F.col("fx") > 0, F.col("fz") > 0
    ok = (
        (~need_b | F.col("_b").isNotNull()) & (~need_c | F.col("_c").isNotNull()) & (~(need_b & need_c) | F.col("_d").isNotNull())
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if method == "linear":
        out = (
            F.col("_a") * (1 - wx) * (1 - wz) + zero("_b") * wx * (1 - wz) + zero("_c") * (1 - wx) * wz + zero("_d") * wx * wz
        )
    else:
        right, down = wx >= 0.5, wz >= 0.5
        out = F.when(right & down, F.col("_d")).when(right, F.col("_b")).when(down, F.col("_c")).otherwise(F.col("_a"))
    return points.where(ok).select(
        "map_id", (F.col("iz") * factor + F.col("fz")).alias("qz"), (F.col("ix") * factor + F.col("fx")).alias("qx"), out.alias(value)
    )


def fill_low_confidence(cells: DataFrame, *, value: str, confidence: str, region: str, fallback: str, threshold: float) -> DataFrame:
    """Replace unsure cells by the nearest sure cell of the same region, else the region median, else a baseline."""
    high = F.coalesce(F.col(confidence) >= threshold, F.lit(False)) & F.col(value).isNotNull()
    rows = cells.withColumn("_high", high)
    keys = ["map_id", region]
    donors = rows.where("_high").select(*keys, "iz", "ix", value)
    near = nearest(rows.where(~F.col("_high")).select(*keys, "iz", "ix"), donors, keys, [value])
    median = percentiles(cells, keys, value, {"_median": 0.5})
    joined = null_safe_join(null_safe_join(rows, near, [*keys, "iz", "ix"], "left"), median, keys, "left")
    donor = F.col(f"donor_{value}") if f"donor_{value}" in joined.columns else F.lit(None).cast("double")
    source = (
        F.when(F.col("_high"), "kept_high_conf")
        .when(donor.isNotNull(), "nearest_same_region_high_conf")
        .when(F.col("_median").isNotNull(), "regional_median_fallback")
        .otherwise("baseline_fallback")
    )
    filled = F.when(F.col("_high"), F.col(value)).otherwise(F.coalesce(donor, F.col("_median"), F.col(fallback)))
    return joined.select(*CELL, filled.alias("filled"), source.alias("fill_source"), F.when(~F.col("_high"), F.col("distance")).alias("fill_distance"))


def pseudo_regions(cells: DataFrame, value: str, good: Column, *, minimum: int = 20, minimum_range: float = 0.35) -> DataFrame:
    """Two regions split at the median of the reliable cells; one region when there are few or they barely vary."""
    ok = cells.where(good)
    stats = ok.groupBy("map_id").agg(F.count(value).alias("_n"), (F.max(value) - F.min(value)).alias("_range"))
    stats = stats.join(percentiles(ok, ["map_id"], value, {"_thr": 0.5}), "map_id")
    split = (F.col("_n") >= minimum) & (F.col("_range") >= minimum_range) & (F.col(value) > F.col("_thr"))
    joined = cells.join(stats, "map_id", "left")
    return joined.select(*cells.columns, F.when(F.coalesce(split, F.lit(False)), 2).otherwise(1).alias("pseudo_region"))


def supported_actions(cells: DataFrame, action: str, *, radius: int, minimum: int) -> DataFrame:
    """Undo an action with too few equal actions around it (action 0 means none)."""
    if radius == 0 or minimum <= 1:
        return cells.select(*CELL, F.col(action).alias("action"))
    counts = F.array_sort(F.collect_list(action))  # at most (2 * radius + 1)^2 entries
    rows = gather(cells, square(radius), [action], [neighbour(action, 0, 0).alias("_a"), counts.alias("_all")])
    support = F.size(F.filter("_all", lambda x: x == F.col("_a")))
    return rows.select(*CELL, F.when((F.col("_a") != 0) & (support < minimum), 0).otherwise(F.col("_a")).alias("action"))


def edge_aware(cells: DataFrame, *, baseline: str, source: str, confidence: str, region: str, threshold: float,
               radii: Sequence[int] = (1, 2, 4), minimum: int = 3) -> DataFrame:
    """Unsure cells take the distance-weighted median of sure neighbours of their region, from the smallest
    radius with enough of them; cells no radius serves keep the baseline."""
    rows = cells.select(*CELL, baseline, source, confidence, region)
    sure = rows.where((F.col(confidence) >= threshold) & F.col(source).isNotNull()).select(
        "map_id", region, F.col("iz").alias("_nz"), F.col("ix").alias("_nx"), F.col(source).alias("_v")
    )
    pending = cut_lineage(rows.where(F.col(confidence) < threshold).select(*CELL, region))
    done = []
    for radius in radii:
        steps = F.array(*[F.struct(F.lit(z).alias("z"), F.lit(x).alias("x")) for z, x in square(radius)])
        asked = pending.withColumn("_o", F.explode(steps)).select(
            "*", (F.col("iz") + F.col("_o.z")).alias("_nz"), (F.col("ix") + F.col("_o.x")).alias("_nx"),
            (F.lit(1.0) / (F.hypot(F.col("_o.z"), F.col("_o.x")) + 0.5)).alias("_w"),
        )
        found = asked.join(sure, ["map_id", region, "_nz", "_nx"])
        enough = found.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum).drop("_n")
        # A neighbourhood holds at most (2 * radius + 1)^2 cells.
        w = Window.partitionBy(*CELL)
        cum = found.join(enough, CELL).groupBy(*CELL, "_v").agg(F.sum("_w").alias("_w")).select(
            *CELL, "_v", F.sum("_w").over(w.orderBy("_v")).alias("_c"), F.sum("_w").over(w).alias("_t")
        )
        half = F.col("_c") >= F.col("_t") * (0.5 - 1e-12)
        chosen = cut_lineage(cum.where(half).groupBy(*CELL).agg(F.min("_v").alias("corrected")).withColumn("used_radius", F.lit(radius)))
        done.append(chosen)
        pending = pending.join(chosen.select(*CELL), CELL, "left_anti")
    return rows.join(reduce(DataFrame.unionByName, done), CELL, "left").select(
        *CELL, F.coalesce("corrected", F.col(baseline)).alias("corrected"), F.col("corrected").isNotNull().alias("used"), "used_radius"
    )


def region_levels(cells: DataFrame, *, value: str, theory: str, confidence: str, region: str, seed: Column) -> DataFrame:
    """Confidence-weighted median level of trusted cells per region, and theory shifted by the median residual."""
    keys = ["map_id", region]
    seeds = cells.where(seed).withColumn("_w", F.greatest(F.col(confidence), F.lit(0.05))).withColumn("_r", F.col(value) - F.col(theory))
    levels = weighted_median(seeds, keys, value, "_w", "region_level")
    shift = weighted_median(seeds, keys, "_r", "_w", "_shift")
    joined = null_safe_join(null_safe_join(cells, levels, keys, "left"), shift, keys, "left")
    return joined.select(
        *CELL, region, "region_level", (F.col(theory) + F.coalesce("_shift", F.lit(0.0))).alias("theory_calibrated")
    )


def label_agreement(cells: DataFrame, labels: str, truth: str) -> DataFrame:
    """Best share of matching labels, also with the two labels swapped."""
    same = F.avg((F.col(labels) == F.col(truth)).cast("double"))
    swapped = F.when(F.col(labels) == 1, 2).when(F.col(labels) == 2, 1).otherwise(F.col(labels))
    return cells.groupBy("map_id").agg(
        F.greatest(same, F.avg((swapped == F.col(truth)).cast("double"))).alias("label_agreement")
    )


def two_centres(cells: DataFrame, value: str = "value", sweeps: int = 20) -> DataFrame:
    """Two-centre median clustering of every map: the centres alternate with the split until they settle.

    The first centre is never the larger one, so its side is the lower values of a map. Every distinct value therefore
    carries, once and for all, the medians of the values up to it and of those after it; a sweep looks up the largest
    value of the first side. Only a two-number state per map is carried between sweeps; medians are exact and
    distributed.
    """
    atoms = cut_lineage(running_totals(cells, ["map_id"], value).select("map_id", F.col(value).alias("_v"), "n", "n_upto", "n_total"))
    ranked = atoms.select("map_id", "_v", F.explode(F.sequence(F.col("n_upto") - F.col("n") + 1, F.col("n_upto"))).alias("_at"))

    def looked_up(rows: DataFrame, by: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
        """Values at (fractional) ranks of the map, linear between neighbours; NULL for a NULL rank."""
        wanted = F.array(*[
            F.struct(F.lit(name).alias("name"), end(r).cast("long").alias("_at"), (1 - F.abs(r - end(r))).alias("share"))
            for name, r in ranks.items() for end in (F.floor, F.ceil)
        ])
        long = rows.select(*by, F.explode(wanted).alias("_w")).select(*by, "_w.*")
        ends = long.distinct().join(ranked, ["map_id", "_at"])
        low, high = (lambda n, f=f: f(F.when(F.col("name") == n, F.col("_v"))) for f in (F.min, F.max))
        share = lambda n: F.min(F.when(F.col("name") == n, F.struct("_at", "share")))["share"]
        return ends.groupBy(*by).agg(*[(low(n) + (1 - share(n)) * (high(n) - low(n))).alias(n) for n in ranks])

    size = F.col("n_total")
    quarter = lambda p: F.greatest(F.lit(1.0), F.least(size.cast("double"), size * p + 0.5))
    maps = atoms.select("map_id", "n_total").distinct()
    state = cut_lineage(looked_up(maps, ["map_id"], {"c1": quarter(0.25), "c2": quarter(0.75)}))
    upto = F.col("n_upto")
    sides = {"_m1": upto * 0.5 + 0.5, "_m2": F.when(upto < size, upto + (size - upto) * 0.5 + 0.5)}
    medians = looked_up(atoms.select("map_id", "n_upto", "n_total"), ["map_id", "n_upto"], sides)
    splits = cut_lineage(atoms.select("map_id", "_v", "n_upto").join(medians, ["map_id", "n_upto"]))
    v, c1, c2 = F.col("_v"), F.col("c1"), F.col("c2")
    first = (c1 == c2) | ((v < c2) & (F.abs(v - c1) <= F.abs(v - c2)))
    for _ in range(sweeps):
        last = splits.join(state, "map_id").where(first).groupBy("map_id").agg(F.max(F.struct("n_upto", "_m1", "_m2")).alias("_s"))
        moved = last.select("map_id", "_s._m1", "_s._m2")
        new = cut_lineage(
            state.join(moved, "map_id").select(
                "map_id", F.col("_m1").alias("c1"), F.coalesce("_m2", "c2").alias("c2"),
                ((F.col("_m1") != c1) | (F.coalesce("_m2", "c2") != c2)).alias("_moved"),
            )
        )
        state = new.drop("_moved")
        if new.where("_moved").isEmpty():
            break
    low, high = F.least("c1", "c2"), F.greatest("c1", "c2")
    return state.select("map_id", low.alias("low_centre"), high.alias("high_centre"), ((low + high) / 2).alias("threshold"))


def profile_labels(cells: DataFrame, centres: DataFrame, value: str = "value") -> DataFrame:
    """Bilayer labels from the axis whose median profile varies more, split at the cluster threshold."""
    def profile(axis: str) -> DataFrame:
        # one row per line of a map, read twice below
        return cut_lineage(percentiles(cells, ["map_id", axis], value, {f"_{axis}": 0.5}))

    columns, lines = profile("ix"), profile("iz")
    spread = columns.groupBy("map_id").agg((F.max("_ix") - F.min("_ix")).alias("_rx")).join(
        lines.groupBy("map_id").agg((F.max("_iz") - F.min("_iz")).alias("_rz")), "map_id"
    )
    joined = cells.join(columns, ["map_id", "ix"]).join(lines, ["map_id", "iz"]).join(spread, "map_id").join(centres, "map_id")
    level = F.when(F.col("_rx") >= F.col("_rz"), F.col("_ix")).otherwise(F.col("_iz"))
    return joined.select(*CELL, F.when(level > F.col("threshold"), 2).otherwise(1).alias("region_label"))


def ring_metrics(cells: DataFrame, keys: Sequence[str], *, pred: str, truth: str, side: str, distance: str) -> DataFrame:
    """Near-ring, far-field and core means around an object, their drop and contrast, and the edge error."""
    soft, hard = F.col(side) == "soft", F.col(side) == "hard"
    d = F.col(distance)
    error = F.lit(100.0) * (F.col(pred) - F.col(truth)) / F.col(truth)
    mean = lambda c, v=None: F.avg(F.when(c, F.col(pred) if v is None else v))
    ring, far, core = soft & (d <= 2), soft & (d > 8), hard & (d > 4)
    return cells.groupBy(*keys).agg(
        F.count_if(ring).alias("N_ring"),
        mean(ring).alias("mean_soft_ring"),
        mean(far).alias("mean_soft_far"),
        (mean(far) - mean(ring)).alias("soft_ring_drop"),
        mean(core).alias("mean_hard_core"),
        mean(core, error).alias("core_signed_error"),
        mean(d <= 2, F.abs(error)).alias("edge_MAPE"),
        (mean(core) - mean(far)).alias("inclusion_contrast"),
    )


def graph_smooth(cells: DataFrame, *, value: str, confidence: str, seed: str, weight: float = 0.25, sweeps: int = 30,
                 edge_sigma: float = 0.20, epsilon: float = 0.03, high: float = 0.80, high_weight: float = 50.0,
                 low_weight: float = 0.5, limits: tuple[float, float] = (0.5, 10.0), tile: int = 64) -> DataFrame:
    """Confidence-weighted, edge-preserving smoothing of maps of any size.

    Every sweep reaches one cell further, so a tile that also carries a rim of
    ``sweeps`` cells gives exactly the result of the whole map in its core.
    Each task holds one tile of at most (tile + 2 * sweeps)^2 cells.
    """
    def reach(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - sweeps) / tile), F.floor((F.col(c) + sweeps) / tile))

    tiles = (
        cells.select(*CELL, F.col(value).alias("v"), F.col(confidence).alias("c"), F.col(seed).alias("s"))
        .withColumn("tz", F.explode(reach("iz")))
        .withColumn("tx", F.explode(reach("ix")))
    )

    def smooth(batch: pd.DataFrame) -> pd.DataFrame:
        z0, x0 = batch["iz"].min(), batch["ix"].min()
        shape = (batch["iz"].max() - z0 + 1, batch["ix"].max() - x0 + 1)
        at = (batch["iz"].to_numpy() - z0, batch["ix"].to_numpy() - x0)
        v, c, s = (np.full(shape, np.nan) for _ in range(3))
        for grid, name in ((v, "v"), (c, "c"), (s, "s")):
            grid[at] = batch[name].to_numpy(float)
        ok = np.isfinite(v) & np.isfinite(c) & np.isfinite(s)
        data = np.where(ok, np.where(c >= high, high_weight, low_weight + c**2), 0.0)
        v, s = np.where(ok, v, 0.0), np.where(ok, s, 0.0)
        edges = []
        for axis in (0, 1):
            n = shape[axis]
            first, second = (np.take(ok, range(0, n - 1), axis), np.take(ok, range(1, n), axis)) if n > 1 else (ok[:0], ok[:0])
            both = first & second if n > 1 else np.zeros((0, 0), bool)
            edges.append(np.where(both, np.exp(-((np.diff(s, axis=axis) / edge_sigma) ** 2)), 0.0) if n > 1 else None)
        u = v.copy()
        for _ in range(sweeps):
            top, bottom = data * v, data.copy()
            for axis, fixed in enumerate(edges):
                if fixed is None:
                    continue
                w = weight * fixed / np.sqrt(np.diff(u, axis=axis) ** 2 + epsilon**2)
                low_side = [slice(None)] * 2
                high_side = [slice(None)] * 2
                low_side[axis], high_side[axis] = slice(0, -1), slice(1, None)
                a, b = tuple(low_side), tuple(high_side)
                ua, ub = u[a].copy(), u[b].copy()
                top[a] += w * ub
                bottom[a] += w
                top[b] += w * ua
                bottom[b] += w
            u = np.where(ok, np.clip(top / np.maximum(bottom, 2.220446049250313e-16), *limits), 0.0)
        tz, tx = batch["tz"].iloc[0], batch["tx"].iloc[0]
        core = (batch["iz"] // tile == tz) & (batch["ix"] // tile == tx)
        out = batch.loc[core, ["map_id", "iz", "ix"]].copy()
        smoothed = np.where(ok, u, np.nan)[at]
        out["smoothed"] = smoothed[core.to_numpy()]
        return out

    types = dict(cells.dtypes)
    schema = f"map_id {types['map_id']}, iz {types['iz']}, ix {types['ix']}, smoothed double"
    return tiles.groupBy("map_id", "tz", "tx").applyInPandas(smooth, schema)


def impute_median(cells: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Missing values get the median of their group."""
    medians = percentiles(cells, keys, value, {"_m": 0.5})
    return null_safe_join(cells, medians, keys, "left").withColumn(value, F.coalesce(value, "_m")).drop("_m")
