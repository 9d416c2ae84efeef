"""Distributed order statistics equal the plain definitions, also when every group counts as oversized."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldgrain.operators import metrics as m, order_stats as os_


@pytest.fixture(scope="module")
def rows(spark):
    # One key holds most rows, and one value of it a third of all rows.
    rng = np.random.default_rng(1)
    data = [("hot", 5.0, i) for i in range(400)]
    data += [("hot", float(v), 400 + i) for i, v in enumerate(rng.normal(size=500).round(3))]
    data += [("cold", float(v), 900 + i) for i, v in enumerate(rng.normal(size=57))]
    data += [(None, 1.0, 2000), ("gap", None, 2001), ("one", 3.0, 2002)]
    return spark.createDataFrame(data, "k string, v double, id int").repartition(7).cache()


def midpoint(x, p):
    x = np.sort(x)
    rank = np.clip(p * len(x) + 0.5, 1, len(x))
    return np.interp(rank, np.arange(1, len(x) + 1), x)


@pytest.mark.parametrize("bits", [(12, 32), (1, 3), (5,)])
def test_percentiles(rows, bits):
    got = {r["k"]: r for r in os_.percentiles(rows, ["k"], "v", {"p5": 0.05, "p50": 0.5, "p90": 0.9}, bits=bits).collect()}
    pdf = rows.toPandas()
    for k in ("hot", "cold", "one"):
        x = pdf[pdf.k == k].v.dropna().to_numpy()
        for name, p in (("p5", 0.05), ("p50", 0.5), ("p90", 0.9)):
            assert got[k][name] == pytest.approx(midpoint(x, p), abs=1e-12)
    assert None in got and "gap" not in got


@pytest.mark.parametrize("bits", [(12, 32), (1, 3), (5,)])
@pytest.mark.parametrize("descending", [False, True])
def test_row_positions(rows, bits, descending):
    out = os_.row_positions(rows, ["k"], "v", ["id"], descending=descending, bits=bits).toPandas()
    pdf = rows.toPandas()
    assert len(out) == pdf.v.notna().sum()
    for k, g in out.groupby("k"):
        assert sorted(g.position) == list(range(1, len(g) + 1))
        ordered = g.sort_values("position").v.to_numpy()
        assert (np.diff(ordered) <= 0).all() if descending else (np.diff(ordered) >= 0).all()


def test_positions_do_not_depend_on_partitioning(rows):
    key = lambda df: sorted(map(tuple, os_.row_positions(df, ["k"], "v", ["id"]).select("id", "position").collect()))
    assert key(rows.repartition(1)) == key(rows.repartition(17))


def test_kendall_and_spearman_against_pairs(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 9, 80), rng.integers(0, 7, 80)
    y = y + x // 3
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)], "g string, x double, y double")
    s = nx = ny = 0
    for i in range(80):
        for j in range(i):
            s += np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
            nx += x[i] != x[j]
            ny += y[i] != y[j]
    got = m.kendall(df, ["g"], "x", "y").first()["kendall"]
    assert got == pytest.approx(s / np.sqrt(float(nx) * float(ny)), abs=1e-12)
    import pandas as pd

    want = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert m.spearman(df, ["g"], "x", "y").first()["spearman"] == pytest.approx(want, abs=1e-12)


def test_hash_positions_cover_every_rank(rows):
    out = os_.hash_positions(rows, [], ["id"], 7).toPandas()
    assert sorted(out.position) == list(range(1, len(out) + 1))
    assert (out.group_size == len(out)).all()


def test_weighted_median_and_areas(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 9.0, 2), ("b", 4.0, 0)], "g string, v double, w int")
    got = {r["g"]: r["m"] for r in m.weighted_median(df, ["g"], "v", "w", "m").collect()}
    assert got == {"a": 2.0}
    scores = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.2, 0)], "s double, y int")
    row = m.curve_areas(scores, [], "s", "y").first()
    assert row["roc_auc"] == pytest.approx(0.75)
    assert row["pr_auc"] == pytest.approx(0.5 * 1.0 + 0.5 * (0.5 + 2 / 3) / 2)


def test_sum_of_groups_matches(rows):
    totals = os_.running_totals(rows, ["k"], "v", bits=(1, 2))
    last = totals.groupBy("k").agg(F.max("n_upto").alias("a"), F.max("n_total").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in last)


@pytest.mark.parametrize("bits", [1, 12, 32, 52])
def test_rounded_values_keep_the_order(spark, bits):
    rng = np.random.default_rng(bits)
    x = np.concatenate([rng.normal(size=400) * 10.0 ** rng.integers(-320, 309, 400), 1.5 + np.arange(200) * 2.0**-40, [0.0, -0.0, 1e308, -1e308, np.inf, -np.inf, 2.0**900, np.nextafter(2.0**900, 0)]])
    df = spark.createDataFrame([(float(v),) for v in np.sort(x)], "v double").coalesce(1)
    out = np.array([r[1] for r in df.select("v", os_.rounded_bits(F.col("v"), bits)).sort("v").collect()])
    assert not np.isnan(out).any() and (out[1:] >= out[:-1]).all()
    finite = np.isfinite(out) & (np.abs(out) > 1e-290)
    assert (np.frexp(out[finite])[0] * 2.0**bits % 1 == 0).all()


def test_extreme_values_texts_and_days_are_ranked(spark):
    inf = float("inf")
    doubles = [-inf, -1e308, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e308, inf, float("nan")]
    data = [(v, f"{'a' * (i // 2)}b{i:02d}", 2**62 + i) for i, v in enumerate(doubles)]
    df = spark.createDataFrame(data, "d double, t string, i long").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("i") - 2**62).cast("int")))
    for c in ("d", "t", "i", "day"):
        got = [r["n_upto"] for r in os_.running_totals(df, [], c).sort(c).collect()]
        assert got == list(range(1, len(doubles) + 1)), c
        back = [r["n_upto"] for r in os_.running_totals(df, [], c, descending=True).sort(F.col(c).desc()).collect()]
        assert back == list(range(1, len(doubles) + 1)), c


def test_no_job_runs_while_a_plan_is_built(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "building")
    os_.percentiles(rows, ["k"], "v", {"m": 0.5})
    os_.row_positions(rows, ["k"], "v", ["id"])
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("tests", "tests")


def test_empty_groups_give_empty_statistics(rows):
    none = rows.where("id < 0")
    assert os_.percentiles(none, [], "v", {"m": 0.5}).where("m is not null").count() == 0
    assert os_.row_positions(none, ["k"], "v", ["id"]).count() == 0
    assert os_.hash_positions(none, [], ["id"], 1).count() == 0


def test_a_key_may_be_called_feature_name(spark):
    """The audit of several features ranks each by itself; the feature's column must not meet a key of its name."""
    from fieldgrain.operators import association as ac

    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(0, 6, 300).astype(float), "b": rng.normal(size=300).round(1), "t": rng.normal(size=300).round(1)})
    pdf.loc[pdf.a == 2, "a"] = None
    pdf.loc[::17, "t"] = None
    rows = spark.createDataFrame(pdf).replace(float("nan"), None)
    audit = {r["feature_name"]: r for r in ac.feature_audit(rows, ["a", "b"], "t", 4).collect()}
    long = ac.long_features(rows, [], ["a", "b"], "t")
    keyed = {r["feature_name"]: r["rho"] for r in m.spearman(long, ["feature_name"], "x", "y", "rho").collect()}
    assert set(audit) == set(keyed) == {"a", "b"}
    for f in audit:
        both = pdf[[f, "t"]].dropna()
        want = both[f].rank().corr(both["t"].rank())
        assert audit[f]["spearman_rho"] == pytest.approx(want, abs=1e-12) and keyed[f] == pytest.approx(want, abs=1e-12)
        assert audit[f]["distinct_values"] == pdf[f].nunique()
        assert audit[f]["missing_pct"] == pytest.approx(100 * pdf[f].isna().mean())


def test_few_groups_are_not_shuffled_by_group(spark):
    """Joins on the group alone send all rows of a feature to one task."""
    from fieldgrain.operators import association as ac, metrics as m

    rows = spark.range(400).selectExpr("CAST(id % 7 AS double) AS a", "CAST(id * 37 % 101 AS double) AS t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for Spark's size check
    try:
        placed = ac.quantile_bin(ac.long_features(rows, [], ["a"], "t"), ["feature_name"], "y", 4, "b", few_groups=True)
        mutual = ac.mutual_information(rows, [], ["a"], "t", 4)
        ranks = m.spearman(rows.withColumn("g", F.lit("a")), ["g"], "a", "t")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "LeftOuter" in plan(mutual) and not any("SortMergeJoin" in line and "LeftOuter" in line for line in plan(mutual).splitlines())
        assert sorted(r[0] for r in placed.groupBy("b").count().select("b").collect()) == [1, 2, 3, 4]
        joins = [line for line in plan(ranks).splitlines() if "SortMergeJoin" in line]
        assert joins and all(line.split("SortMergeJoin", 1)[1].count("coalesce") >= 2 for line in joins)
        pdf = rows.toPandas()
        want = np.corrcoef(pdf.a.rank(), pdf.t.rank())[0, 1]
        assert ranks.first()["spearman"] == pytest.approx(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_target_ranks_are_counted_once_for_all_features(spark):
    """Rows are not copied per feature before their targets are ranked, and a feature's missing rows have no rank."""
    from fieldgrain.operators import association as ac

    rng = np.random.default_rng(8)
    data = [("a" if i % 3 else None, float(i % 7) if i % 5 else None, float(rng.integers(0, 9)), float(rng.integers(0, 40))) for i in range(400)]
    rows = spark.createDataFrame(data, "g string, p double, q double, t double").repartition(5)
    out = ac.association(rows, ["g"], ["p", "q"], "t", with_kendall=False)
    pdf = rows.toPandas()
    for r in out.collect():
        part = pdf[pdf.g.isna() if r["g"] is None else pdf.g == r["g"]][[r["feature_name"], "t"]].dropna()
        assert r["spearman_rho"] == pytest.approx(part[r["feature_name"]].rank().corr(part.t.rank()), abs=1e-12)
        assert r["n_valid"] == len(part)
    ranks = m.rank_correlations(rows, ["g"], {c: F.col(c) for c in ("p", "q")}, F.col("t"), "r")
    joins = [line for line in ranks._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "_y#" in line]
    assert len(joins) == 1


def test_running_totals_do_not_join_values_to_their_cells(rows):
    plan = os_.running_totals(rows, ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("few", [False, True])
def test_equal_count_bins_are_those_of_positions(rows, few):
    """Only the rows of values that a limit divides are put in hash order."""
    used = F.least(F.lit(6), F.col("group_size"))
    want = os_.row_positions(rows, ["k"], "v", ["id"]).withColumn("b", F.ceil(F.col("position") * used / F.col("group_size")))
    got = os_.equal_count_bins(rows, ["k"], "v", ["id"], 6, "b", few_groups=few)
    pairs = lambda df: sorted(map(tuple, df.select("id", "b").collect()))
    assert pairs(got) == pairs(want)
    alone = os_.equal_count_bins(rows, [], "v", ["id"], 4, "b", few_groups=few)
    assert sorted(r["b"] for r in alone.collect()) == [min(4, -(-(i + 1) * 4 // 959)) for i in range(959)]


def test_hotspots_are_cut_off_at_a_rank_without_ordering_all_rows(spark):
    data = [(f"e{i:03d}", float(i % 50), True, i % 3, i % 5) for i in range(300)]
    placed = spark.createDataFrame(data, f"example_id string, {m.ABS_ERROR} double, sws_valid boolean, cx int, cz int")
    got = m.hotspots_and_controls(placed, 0.03)
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()
    hot = sorted(r["example_id"] for r in got.where("selection_group = 'hotspot'").collect())
    assert hot == sorted([f"e{i:03d}" for i in range(300) if i % 50 == 49] + ["e048", "e098", "e148"])


def test_copies_of_rows_are_not_shuffled_for_percentiles(spark):
    data = [(f"p{i % 2}", f"b{i % 3}", i % 4, i / 10, i / 9, 1.0 * i, -1.0 * i, float(i), True) for i in range(90)]
    frame = spark.createDataFrame(data, f"part string, brand string, size int, q_true double, q_pred double, cs_error_m_s double, cs_error_percent double, {m.ABS_ERROR} double, sws_valid boolean")
    groupings = {"by_brand": ["brand"], "by_size": ["size"], "both": ["brand", "size"]}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large for Spark's size check
    try:
        few = m.grouped_tables(frame, groupings, ["part"], few_groups=True)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert not any("SortMergeJoin" in line and "_cell#" in line for line in plan.splitlines())
        key = lambda df: sorted(map(tuple, df.select("table_name", "part", "level_1", "level_2", "sws_median_ape", "q_median_ae").collect()), key=str)
        assert key(few) == key(m.grouped_tables(frame, groupings, ["part"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
