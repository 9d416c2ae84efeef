"""Held-out studies, risk and gates, stateful deliveries, windows from tiles: against separate fits and brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrain.operators import centers as ct, coverage as cov, models as md, registry as rg, risk as rk, studies as st, tiles as tl
from fieldgrain.streaming import incremental as inc

GRID = cov.CoverageGrid(sws_edges=(1.5, 3.0, 4.5), frequency_edges=(400, 600), purity_edges=(0.5, 0.7, 0.9, 1.0001), diffusivity_edges=(0, 1), pairs_m=((5e-4, 5e-4),))


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(5)
    rows = []
    for _ in range(600):
        a, b, g, k = draw.gauss(5, 2), draw.random(), draw.choice("uvw"), draw.randint(1, 4)
        rows.append((a, b, 7.0, g, k, 0.2 + 0.03 * a + 0.2 * b + draw.gauss(0, 0.01)))
    rows += [(None, 0.5, 7.0, "u", 1, 0.5), (float("nan"), 0.5, 7.0, "u", 1, 0.5), (5.0, 0.5, 7.0, None, 2, 0.45)]
    return spark.createDataFrame(rows, "a double, b double, flat double, g string, k int, y double").repartition(4)


def test_heldout_fits_equal_separate_fits(table):
    axes = {"g": F.col("g"), "k": F.col("k")}
    good = table.where(md.usable(["a", "b", "flat", "y"]))
    fits = {(r["axis"], r["level"]): r for r in st.holdout_fits(good, axes, ["a", "b", "flat"], "y", 2.0).collect()}
    assert set(fits) == {("g", x) for x in ("u", "v", "w", None)} | {("k", str(x)) for x in range(1, 5)}
    for axis, level in (("g", "v"), ("k", "3")):
        train = good.where(~F.col(axis).cast("string").eqNullSafe(F.lit(level)))
        alone = md.fit(train, "ridge", ["a", "b", "flat"], "y", penalty=2.0)
        slopes = np.array(alone.coefficients[1:]) / np.array(alone.sigma)
        want = [alone.coefficients[0] - slopes @ np.array(alone.mu), *slopes]
        got = fits[axis, level]
        assert got["train_count"] == train.count()
        point = np.array([1, 4.0, 0.3, 7.0])
        assert np.isclose(np.array(got["coefficients"]) @ point, np.array(want) @ point, atol=1e-9)
        assert np.allclose(got["coefficients"][1:3], want[1:3], atol=1e-9)


def test_heldout_study_beats_the_fixed_baseline(table):
    out = st.holdout_study(table, {"g": F.col("g"), "k": F.col("k")}, ["a", "b"], "y").collect()
    assert sum(r["test_count"] for r in out if r["axis"] == "k") == 601
    assert all(r["q_mae"] < 0.3 * r["fixed_mae"] for r in out if r["test_count"] > 5)


def test_a_level_that_holds_all_rows_has_no_fit(spark):
    rows = spark.createDataFrame([(1.0, "x", 0.3), (2.0, "x", 0.4)], "a double, g string, y double")
    out = st.holdout_study(rows, {"g": F.col("g")}, ["a"], "y").collect()
    assert [(r["train_count"], r["test_count"], r["q_mae"]) for r in out] == [(0, 2, None)]


def test_leaking_predictors_stop_a_fit(table):
    leaky = table.withColumn("truth_x", F.col("a"))
    for call in (lambda: md.fit(leaky, "ridge", ["a", "truth_x"], "y"), lambda: st.holdout_fits(leaky, {"g": F.col("g")}, ["truth_x"], "y")):
        with pytest.raises(ValueError, match="truth_x"):
            call()


def test_named_roles(spark):
    names = {
        "q_local_req": ("diagnostic", "req_diagnostic", False), "M": ("diagnostic", "req_diagnostic", False), "req_mapping": ("diagnostic", "req_mapping", False),
        "REQ_Nbins_effective": ("metadata", "operational_context", True), "campaign_seed": ("metadata", "campaign", False), "campaign_other": ("metadata", "campaign", False),
        "SIM_WaveModel": ("metadata", "wavefield_model", False), "campaign_run_id": ("identifier", "identity", False), "q_theory_valid": ("diagnostic", "theory_baseline", False),
    }
    frame = spark.createDataFrame([tuple(1.0 for _ in names)], ", ".join(f"{n} double" for n in names))
    got = {r["variable_name"]: (r["role"], r["group"], r["trainable"]) for r in rg.variable_registry(frame).collect()}
    assert got == names


def test_rows_are_scored_in_place_even_with_equal_ids(spark):
    rows = spark.createDataFrame([("e", float(i), 0.5) for i in range(5)] + [("e", None, 0.5), ("e", float("inf"), 0.5)], "example_id string, a double, y double")
    model = md.fit(rows, "ridge", ["a"], "y")
    out = md.score_valid(rows, model, ["a"])
    assert out.columns == ["example_id", "a", "y", "q_pred", "prediction_valid"]
    got = out.collect()
    assert len(got) == 7 and sum(r["prediction_valid"] for r in got) == 5
    assert all((r["q_pred"] is not None) == r["prediction_valid"] for r in got)
    assert Counter(repr(r["a"]) for r in got) == Counter(repr(r["a"]) for r in rows.collect())


def test_cell_means_leave_the_own_fold_out(spark):
    draw = random.Random(2)
    rows = [(draw.choice(["p", "q", None]), draw.choice([0, 1, 2, None]), draw.choice([0, 1, None])) for _ in range(200)]
    frame = spark.createDataFrame(rows, "cell string, cv_fold int, hit int").repartition(3)
    taught = [(c, f, h) for c, f, h in rows if f is not None and h is not None]
    mean = sum(h for *_, h in taught) / len(taught)
    for r in rk.cell_means(frame, ["cell"], {"rate": "hit"}, prior=4.0).collect():
        own = [h for c, f, h in taught if c == r["cell"] and f != r["cv_fold"]]
        assert math.isclose(r["rate"], (sum(own) + 4 * mean) / (len(own) + 4))


def test_gates_against_brute_force(spark):
    draw = random.Random(9)
    rows = []
    for i in range(300):
        for name in ("lift", "lower"):
            gain = draw.gauss(0, 3)
            rows.append((i, name, 10.0, 10.0 - gain, gain, int(gain < -0.5), gain + draw.gauss(0, 2), min(1.0, max(0.0, 0.4 - 0.1 * gain + draw.gauss(0, 0.1))), i % 4 or None))
    kind = "k int, candidate string, base_error double, candidate_error double, gain double, harm int, expected_gain double, harm_probability double, cv_fold int"
    scored = spark.createDataFrame(rows, kind)
    gains, harms = [0.0, 1.0, 3.0], [0.2, 0.4]
    best = {}
    for name in ("lift", "lower"):
        for g in gains:
            for h in harms:
                kept = [r for r in rows if r[1] == name and r[8] and r[6] >= g and r[7] <= h]
                if kept and 100 * sum(r[5] for r in kept) / len(kept) <= 20:
                    best[name] = max(best.get(name, (-1e9,)), (round(sum(r[4] for r in kept), 6), g, -h))
    choice = rk.gate_choice(scored, gains, harms, most_harm_pct=20)
    assert {r["candidate"]: (round(r["total_gain"], 6), r["min_gain"], -r["max_harm"]) for r in choice.collect()} == best
    out = {r["k"]: r for r in rk.gated(scored, choice, ["k"], harm_penalty=5.0).collect()}
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for k, pair in by.items():
        fine = [(r[6] - 5 * r[7], r[1], r[3]) for r in pair if r[6] >= best[r[1]][1] and r[7] <= -best[r[1]][2]]
        assert (out[k]["chosen"], out[k]["chosen_error"]) == ((max(fine)[1], max(fine)[2]) if fine else ("base", 10.0))


def test_risk_tables_of_a_perfect_score(spark):
    rows = spark.createDataFrame([("d", 0.9 if e > 20 else 0.1, float(e)) for e in (1, 5, 12, 25, 40)], "g string, risk double, err double")
    counts = rk.risk_counts(rows, "g", "risk", "err")
    cut = rk.risk_thresholds(counts, "g", "risk", [0.5]).first()
    assert (cut["N"], cut["low_confidence_pct"], cut["precision_high20_pct"], cut["recall_high20_pct"], cut["MAPE_high_confidence"]) == (5, 40.0, 100.0, 100.0, 6.0)
    assert rk.risk_areas(rows, "g", "risk", "err").first()["roc_auc"] == 1.0
    assert [(r["risk_bin_low"], r["N"]) for r in rk.risk_calibration(counts, "g", "risk", [0, 0.5, 1]).orderBy("risk_bin_low").collect()] == [(0.0, 3), (0.5, 2)]


def test_chained_counts_over_repeated_deliveries_and_restarts(spark, tmp_path):
    draw = random.Random(3)
    kind = "example_key long, run string, condition string, coverage_valid boolean, coverage_cell_key string"
    rows = [(i, f"r{draw.randint(0, 9)}", draw.choice(["c1", "c2", None]), draw.random() < 0.9, draw.choice(["s01_f01_p01_d01_g01", "s02_f01_p03_d01_g01"])) for i in range(200)]
    items = {"example": "example_key", "independent_run": "run", "independent_condition": "condition"}
    for part in (rows[:80], rows[80:140], rows[:30] + rows[140:]):
        spark.createDataFrame(part, kind).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        inc.write_batches(inc.coverage_counts_stream(stream, items), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    counts = inc.latest_counts(spark.read.parquet(f"{tmp_path}/out"))
    got = {r["cell_key"]: r for r in inc.deficits_of_counts(counts, GRID, minimum_examples=1000).collect()}
    assert len(got) == 6
    for cell, r in got.items():
        mine = [x for x in rows if x[3] and x[4] == cell]
        want = len(mine), len({x[1] for x in mine}), len({x[2] for x in mine if x[2]})
        assert (r["example_count"], r["independent_run_count"], r["independent_condition_count"]) == want
        assert r["example_deficit"] == 1000 - len(mine)


def test_new_runs_keep_all_their_rows(spark, tmp_path):
    rows = [(f"r{i % 3}", i // 3, float(i)) for i in range(30)]
    kind = "run_id string, ix int, v double"
    for part in (rows[:30], rows[:30], [("r9", 0, 1.0), ("r9", 1, 2.0)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        extract = lambda b: b.groupBy("run_id").agg(F.count("*").alias("n"))
        inc.featurise_new_runs(stream, f"{tmp_path}/out", f"{tmp_path}/state", extract, key=["run_id", "ix"]).awaitTermination()
    assert sorted((r["run_id"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("r0", 10), ("r1", 10), ("r2", 10), ("r9", 2)]


def bilayer(spark, side=31):
    rows = [("a", z, x, 2.0 if x < 16 else 4.0, 1 if x < 16 else 2, True) for z in range(side) for x in range(side)]
    return spark.createDataFrame(rows, "sample_id string, iz int, ix int, cs_true double, material_id int, valid boolean").repartition(5)


@pytest.mark.parametrize("tile", [6, 11, 128])
@pytest.mark.parametrize("step", [1, 3])
def test_window_truth_against_brute_force(spark, tile, step):
    draw = random.Random(4)
    cells = {("a", z, x): (draw.random(), draw.randint(1, 3), draw.random() < 0.8) for z in range(3, 20) for x in range(-4, 12) if draw.random() < 0.9}
    cells |= {("b", z, x): (1.0, 1, False) for z in range(6) for x in range(6)} | {("a", 3, -4): (1.0, 1, True), ("a", 19, 11): (1.0, 1, True)}
    frame = spark.createDataFrame([(*k, *v) for k, v in cells.items()], "sample_id string, iz int, ix int, cs_true double, material_id int, valid boolean").repartition(3)
    got = {(r["sample_id"], r["cz"], r["cx"]): r for r in tl.window_truth(frame, 5, step=step, tile=tile).collect()}
    bounds = {"a": (3, 19, -4, 11), "b": (0, 5, 0, 5)}
    want = {(s, z, x) for s, (a, b, c, d) in bounds.items() for z in range(a + 2, b - 1, step) for x in range(c + 2, d - 1, step)}
    assert set(got) == want
    for (s, z, x), r in got.items():
        near = [cells[s, i, j] for i in range(z - 2, z + 3) for j in range(x - 2, x + 3) if (s, i, j) in cells]
        seen = Counter(m for _, m, ok in near if ok)
        n = sum(seen.values())
        assert math.isclose(r["truth_valid_fraction"], n / 25)
        assert r["truth_material_purity"] is None if n == 0 else math.isclose(r["truth_material_purity"], max(seen.values()) / n)
        assert r["truth_cs_center_m_s"] == (cells[s, z, x][0] if (s, z, x) in cells else None)


def _candidates(spark):
    windows = tl.window_truth(bilayer(spark), 5, tile=9)
    constant = {"campaign_frequency_hz": 500.0, "campaign_angular_entropy": 0.5, "GRID_dx_m": 5e-4, "GRID_dz_m": 5e-4}
    return tl.center_candidates(windows.withColumns({c: F.lit(v) for c, v in constant.items()}), GRID)


def test_candidates_add_up_and_serve_several_cells(spark):
    found = _candidates(spark)
    outcomes = Counter(r["outcome"] for r in found.collect())
    assert sum(outcomes.values()) == 27 * 27 and set(outcomes) <= {"eligible", "out_of_range", "too_few_valid"}
    pool = found.where("outcome = 'eligible'").select(F.col("sample_id").alias("run_id"), "cx", "cz", F.col("coverage_cell_key").alias("cell_key"))
    cells = [f"s{s:02d}_f01_p{p:02d}_d01_g01" for s in (1, 2) for p in (1, 3)]
    asked = spark.createDataFrame([(c, i, 4) for i, c in enumerate(cells)], "cell_key string, ordinal int, needed int")
    chosen = ct.directed_centers(pool, asked, per_cell=4, distance=0, step=1).collect()
    assert Counter(r["cell_key"] for r in chosen) == dict.fromkeys(cells, 4)
    assert len({(r["cx"], r["cz"]) for r in chosen}) == len(chosen)
    again = ct.directed_centers(pool.repartition(7), asked, per_cell=4, distance=0, step=1).collect()
    assert sorted(map(tuple, chosen)) == sorted(map(tuple, again))


def test_centres_keep_their_distance(spark):
    found = _candidates(spark).where("outcome = 'eligible'")
    pool = found.select(F.col("sample_id").alias("run_id"), "cx", "cz", F.col("coverage_cell_key").alias("cell_key"))
    asked = spark.createDataFrame([("s01_f01_p03_d01_g01", 0, 20)], "cell_key string, ordinal int, needed int")
    chosen = [(r["cx"], r["cz"]) for r in ct.directed_centers(pool, asked, per_cell=20, distance=5, step=1).collect()]
    assert len(chosen) > 3
    assert all(math.dist(a, b) >= 5 for i, a in enumerate(chosen) for b in chosen[:i])
