"""Windows, spectra, maps, selection, models and streams against brute force or closed forms."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldgrain.operators import centers as ct, maps as mp, models as md, patches as pt, spectrum as spx, theory as th
from fieldgrain.operators.curves import truth_quantile, with_ecum
from fieldgrain.sources import datasets as ds, ledger as lg
from fieldgrain.streaming import incremental as inc


@pytest.fixture(scope="module")
def plane_wave(spark):
    """81 x 81 two-wave field: 400 Hz, 2 m/s, 0.5 mm spacing."""
    n, d, k = 81, 0.5e-3, 2 * math.pi * 400 / 2
    z, x = np.mgrid[0:n, 0:n]
    v = np.sin(k * (0.8 * x + 0.6 * z) * d) + 0.35 * np.cos(k * (-0.4 * x + 0.9 * z) * d + 0.2)
    pdf = pd.DataFrame({"iz": z.ravel(), "ix": x.ravel(), "re": v.ravel()})
    pixels = spark.createDataFrame(pdf).select(
        F.lit("s").alias("sample_id"), F.col("iz").cast("int"), F.col("ix").cast("int"), "re", F.lit(0.0).alias("im"),
        F.lit(2.0).alias("cs_true"), F.lit(1).alias("material_id"), F.lit(True).alias("valid"),
    )
    samples = spark.createDataFrame([("s", n, n, d, d, 400.0)], "sample_id string, nz int, nx int, dx_m double, dz_m double, frequency_hz double")
    return pixels, samples, v


def test_spectrum_matches_numpy_and_curve_holds_the_truth(plane_wave):
    pixels, samples, v = plane_wave
    members = pt.grid_members(pixels.join(samples.select("sample_id", "frequency_hz"), "sample_id"), samples, 21, 10)
    spectra = spx.patch_spectra(pt.patch_arrays(members, ["frequency_hz"]), 21, keep_power=True, sigma=0.0)
    assert spectra.count() == 49
    row = spectra.where("cz = 30 and cx = 40").first()
    patch = v[20:41, 30:51]
    w = spx.hann(21, 0.5e-3, 0.5e-3, 1.0)
    assert w[0, 0] == 0 and w[10, 10] == 1
    shaped = (patch - (patch * w).sum() / w.sum()) * w
    shaped /= np.sqrt((shaped**2).mean())
    want = np.abs(np.fft.fftshift(np.fft.fft2(np.pad(shaped, 21)))) ** 2
    want[31, 31] = 0
    assert np.allclose(np.array(row["power"]).reshape(63, 63), want, atol=1e-6 * want.max())
    target = truth_quantile(with_ecum(spectra), F.col("frequency_hz"), F.lit(2.0)).toPandas()
    assert target.target_valid.all() and (target.target_q > 0.2).all() and (target.target_q < 0.95).all()


def test_empty_window_gives_null_features(spark, plane_wave):
    pixels, samples, _ = plane_wave
    flat = pixels.withColumn("re", F.lit(0.0)).join(samples.select("sample_id", "frequency_hz"), "sample_id")
    patches = pt.patch_arrays(pt.grid_members(flat, samples, 21, 30), ["frequency_hz"])
    assert {r["valid"] for r in spx.patch_spectra(patches, 21).select("valid").collect()} == {False}
    features = spx.patch_features(patches, 21).toPandas()
    assert len(features) == 9
    assert features[["radial_entropy", "ang_entropy", "ecum_auc_norm"]].isna().all().all()


def test_smoothing_kernel():
    p = np.zeros((1, 9, 9))
    p[0, 4, 4] = 1
    s = spx.smooth(p, 1.0)
    assert s.sum() == pytest.approx(1) and s[0, 4, 4] == s.max() and (s[0, :, 7:] == 0).all()


def test_separated_peaks(spark):
    x = [0.0] * 72
    x[0], x[1], x[20], x[70], x[40] = 5.0, 4.9, 3.0, 4.0, 1.0
    df = spark.createDataFrame([(x,)], "w array<double>")
    row = df.select(spx.separated_peaks("w", 6, 8).alias("p")).first()["p"]
    # 1 and 70 lie within six bins of 0 on the circle.
    assert list(row["bins"][:3]) == [0, 20, 40] and list(row["values"][:3]) == [5.0, 3.0, 1.0]


def test_theory_values_are_ordered():
    args = (0.5e-3, 0.5e-3, 400.0, 2.0, 2.0)
    single, diffuse = th.theory_value("SingleWave", *args), th.theory_value("Diffuse3D", *args)
    mixed = th.theory_value("PartialDiffuse3D", *args)
    assert 0 < single < 1 and 0 < diffuse < 1 and mixed == pytest.approx((single + diffuse) / 2)
    assert diffuse > single
    assert 0 <= th.theory_value("Diffuse2D", *args) <= 1 and 0 <= th.theory_value("Diffuse3D", *args, mode="SRAD") <= 1


def test_spread_power_is_a_centred_convolution():
    rng = np.random.default_rng(0)
    a, b = rng.random((7, 7)), rng.random((7, 7))
    full = np.zeros((13, 13))
    for i in range(7):
        for j in range(7):
            full[i : i + 7, j : j + 7] += a[i, j] * b
    assert np.allclose(th.spread_power(a, b), full[3:10, 3:10])


def whole_map_smoothing(v, c, s, sweeps):
    data = np.where(c >= 0.8, 50.0, 0.5 + c**2)
    wr, wd = np.exp(-((np.diff(s, axis=1) / 0.2) ** 2)), np.exp(-((np.diff(s, axis=0) / 0.2) ** 2))
    u = v.copy()
    for _ in range(sweeps):
        num, den = data * v, data.copy()
        for axis, w0 in ((1, wr), (0, wd)):
            w = 0.25 * w0 / np.sqrt(np.diff(u, axis=axis) ** 2 + 0.03**2)
            a = (slice(None), slice(0, -1)) if axis else (slice(0, -1), slice(None))
            b = (slice(None), slice(1, None)) if axis else (slice(1, None), slice(None))
            num[a] += w * u[b]
            den[a] += w
            num[b] += w * u[a]
            den[b] += w
        u = np.clip(num / den, 0.5, 10)
    return u


def test_tiled_smoothing_equals_the_whole_map(spark):
    rng = np.random.default_rng(2)
    v, c, s = rng.uniform(1, 4, (40, 37)), rng.random((40, 37)), rng.uniform(1, 1.5, (40, 37))
    z, x = np.mgrid[0:40, 0:37]
    pdf = pd.DataFrame({"map_id": 1, "iz": z.ravel(), "ix": x.ravel(), "v": v.ravel(), "c": c.ravel(), "s": s.ravel()})
    out = mp.graph_smooth(spark.createDataFrame(pdf), value="v", confidence="c", seed="s", sweeps=6, tile=8).toPandas()
    assert len(out) == 40 * 37
    got = out.sort_values(["iz", "ix"]).smoothed.to_numpy().reshape(40, 37)
    assert np.allclose(got, whole_map_smoothing(v, c, s, 6), atol=1e-12)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    t = pd.DataFrame({"g": rng.integers(0, 3, 120), "iz": rng.integers(0, 60, 120), "ix": rng.integers(0, 60, 120)}).drop_duplicates()
    d = pd.DataFrame({"g": rng.integers(0, 2, 9), "iz": rng.integers(0, 60, 9), "ix": rng.integers(0, 60, 9)}).drop_duplicates()
    out = mp.nearest(spark.createDataFrame(t), spark.createDataFrame(d), ["g"], []).toPandas()
    assert len(out) == len(t)
    for r in out.itertuples():
        same = d[d.g == r.g]
        if same.empty:
            assert np.isnan(r.distance)
        else:
            assert r.distance == pytest.approx(np.hypot(same.iz - r.iz, same.ix - r.ix).min())


def test_two_centres(spark):
    rows = [(1, 0, i, 1.0 + 0.01 * i) for i in range(20)] + [(1, 1, i, 5.0 + 0.01 * i) for i in range(20)]
    df = spark.createDataFrame(rows, "map_id int, iz int, ix int, value double")
    row = mp.two_centres(df).first()
    assert row["low_centre"] == pytest.approx(1.095) and row["high_centre"] == pytest.approx(5.095)
    labels = mp.profile_labels(df, mp.two_centres(df)).groupBy("iz").agg(F.min("region_label").alias("a"), F.max("region_label").alias("b"))
    assert sorted(map(tuple, labels.collect())) == [(0, 1, 1), (1, 2, 2)]


def test_directed_centers_equal_a_full_walk(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"run_id": rng.choice(["a", "b"], 900, p=[0.8, 0.2]), "cx": rng.integers(0, 30, 900) * 4, "cz": rng.integers(0, 30, 900) * 4})
    pdf = pdf.drop_duplicates().assign(cell_key=lambda t: "c" + (t.cx // 40).astype(str))
    requests = pd.DataFrame({"cell_key": ["c1", "c0"], "ordinal": [1, 2], "needed": [3, 9]})
    out = ct.directed_centers(spark.createDataFrame(pdf), spark.createDataFrame(requests), per_cell=4, distance=10.0, step=4, seed=3).toPandas()
    import hashlib

    for run, g in pdf.groupby("run_id"):
        taken = []
        for cell, quota in (("c1", 3), ("c0", 4)):
            rows = g[g.cell_key == cell]
            order = sorted(rows.itertuples(), key=lambda r: (hashlib.md5(f"3:{run}:{r.cx}:{r.cz}".encode()).hexdigest(), r.cz, r.cx))
            n = 0
            for r in order:
                if n < quota and all(math.hypot(r.cx - x, r.cz - z) >= 10 for x, z, _ in taken):
                    taken.append((r.cx, r.cz, cell))
                    n += 1
        got = out[out.run_id == run].sort_values("center_rank")
        assert [(r.cx, r.cz, r.cell_key) for r in got.itertuples()] == taken


def test_deficit_centers_equal_a_greedy_loop(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"run_id": "a", "cx": rng.integers(0, 12, 200) * 4, "cz": rng.integers(0, 12, 200) * 4}).drop_duplicates(["cx", "cz"])
    pdf["cell_key"] = np.where(pdf.cx < 16, "k1", np.where(pdf.cx < 32, "k2", "k3"))
    state = pd.DataFrame({"cell_key": ["k1", "k2", "k3"], "coverage_complete": [False, False, True], "example_count": [0, 5, 90],
                          "example_deficit": [9, 4, 0], "independent_run_deficit": [2, 2, 0], "independent_condition_deficit": [1, 1, 0], "deficit_score": [2.0, 1.0, 0.0]})
    first = pdf.iloc[[0]]
    out = ct.deficit_centers(spark.createDataFrame(pdf), spark.createDataFrame(state), spark.createDataFrame(first), per_run=5, per_cell=2,
                             window=21, realizations=3, fraction=0.3, seed=4).orderBy("center_rank").toPandas()
    chosen = [(first.cx.iloc[0], first.cz.iloc[0], first.cell_key.iloc[0])]
    info = state.set_index("cell_key")
    for _ in range(4):
        best = None
        for r in pdf.itertuples():
            s = info.loc[r.cell_key]
            quota = min(2, max(1, math.ceil(s.example_deficit / 3), int(s.independent_run_deficit > 0), int(s.independent_condition_deficit > 0)))
            gaps = [math.hypot(r.cx - x, r.cz - z) for x, z, _ in chosen]
            if s.coverage_complete or min(gaps) == 0 or min(gaps) < 0.3 * 21 or sum(c == r.cell_key for _, _, c in chosen) >= quota:
                continue
            tie = (r.cx * 73856093 + r.cz * 19349663 + 4 * 83492791) % (2**31 - 1)
            score = (s.independent_run_deficit, s.independent_condition_deficit, s.example_deficit, s.deficit_score, s.example_count == 0, min(gaps), -tie)
            if best is None or score > best[0]:
                best = (score, (r.cx, r.cz, r.cell_key))
        if best is None:
            break
        chosen.append(best[1])
    assert [(r.cx, r.cz, r.cell_key) for r in out.itertuples()] == chosen


def test_ridge_and_neighbours_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)) * [1, 10, 0] + [0, 5, 2]
    y = 0.5 + 0.05 * x[:, 0] - 0.01 * x[:, 1] + rng.normal(size=300) * 0.01
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, example_id=[f"e{i}" for i in range(300)])
    df = spark.createDataFrame(pdf).repartition(5)
    model = md.fit(df, "ridge", ["a", "b", "c"], "y", penalty=2.0)
    mu, sd = x.mean(0), x.std(0, ddof=1)
    sd[sd <= 1e-12] = 1
    design = np.column_stack([np.ones(300), (x - mu) / sd])
    want = np.linalg.solve(design.T @ design + np.diag([0, 2.0, 2, 2]), design.T @ y)
    assert np.allclose(model.coefficients, want, atol=1e-9)
    assert md.RidgeModel.from_json(model.to_json()).coefficients == model.coefficients
    train, test = df.where("example_id < 'e2'"), df.where("example_id >= 'e2'")
    got = md.nearest_neighbours(test, train, ["a", "b"], "y", 5, "example_id").toPandas()
    t = train.toPandas()
    z = (t[["a", "b"]] - t[["a", "b"]].mean()) / t[["a", "b"]].std(ddof=1)
    for r in got.itertuples():
        p = (np.array([r.a, r.b]) - t[["a", "b"]].mean().to_numpy()) / t[["a", "b"]].std(ddof=1).to_numpy()
        near = np.argsort(np.hypot(*(z.to_numpy() - p).T))[:5]
        assert r.prediction == pytest.approx(t.y.to_numpy()[near].mean(), abs=1e-9)


def test_out_of_fold_scores_every_row_once(spark, tmp_path):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "partition": ["train"] * 150 + ["test"] * 50, "cv_fold": [i % 3 + 1 for i in range(150)] + [0] * 50})
    pdf["y"] = 0.5 + 0.1 * np.tanh(pdf.a)
    pdf["example_id"] = [f"e{i}" for i in range(200)]
    df = spark.createDataFrame(pdf)
    scored, final = md.out_of_fold(df, "bagged_trees", ["a"], "y", 3, trees=10, depth=5)
    out = scored.toPandas()
    assert len(out) == 200 and out.example_id.is_unique and out.q_pred.between(0.001, 0.999).all()
    assert (out[out.partition == "train"].prediction_source == "out_of_fold").all()
    assert (out.q_pred - out.y).abs().mean() < 0.03
    assert len(md.fold_summary(scored, "y").collect()) == 3
    md.save_model(final, str(tmp_path), "bag", spark, target="y")
    loaded, meta = md.load_model(str(tmp_path), "bag", spark)
    assert meta == {"target": "y"} and md.model_registry(str(tmp_path), spark).count() == 1
    a = md.score(df, final).orderBy("example_id").toPandas().q_pred
    assert np.allclose(a, md.score(df, loaded).orderBy("example_id").toPandas().q_pred)
    holes = df.withColumn("a", F.when(F.col("example_id") != "e3", F.col("a")))
    valid = md.score_valid(holes, final, ["a"])
    assert valid.count() == 200 and valid.where("not prediction_valid").count() == 1


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{i}", f"c{i % 4}", f"r{i % 8}", "train", 1, i % 2) for i in range(40)],
                                 "example_id string, campaign_condition_id string, campaign_run_id string, partition string, cv_fold int, window_M int")
    ds.write_dataset(rows, f"{tmp_path}/d", summary=rows.groupBy("partition").count(), manifest={"rows": 40, "nested": {"a": [1, 2]}}, partition=["window_M"])
    assert spark.read.parquet(f"{tmp_path}/d/examples").count() == 40
    assert ds.read_manifest(spark, f"{tmp_path}/d/manifest") == {"rows": 40, "nested": {"a": [1, 2]}}
    ds.write_split(rows, f"{tmp_path}/s", {"seed": 1})
    assert ds.read_split(spark, f"{tmp_path}/s", rows.drop("partition", "cv_fold")).count() == 40
    header = ",".join(f.name for f in lg.LEDGER_SCHEMA.fields)
    for run, status in (("20240101", "completed"), ("20240202", "failed")):
        folder = tmp_path / "runs" / run
        folder.mkdir(parents=True)
        (folder / "ledger.csv").write_text(f"{header}\n1,r1,kw,h1,{status},completed_valid,sc,5,200,2.0,8,1,d,c,w,s,v\n")
    kept, rejected = lg.inventory(lg.read_ledger(spark, f"{tmp_path}/runs/20240101"))
    assert kept.count() == 1 and rejected.count() == 0
    newest = ds.read_results(spark, f"{tmp_path}/runs/*/ledger.csv", {"id": ["RUN_ID", "run"], "state": ["status"]}, lg.LEDGER_SCHEMA.simpleString()[7:-1].replace(":", " "))
    assert [tuple(r) for r in newest.collect()] == [("r1", "failed")]


def test_incremental_build(spark):
    previous = spark.createDataFrame([("e1", "r1", "h")], "example_id string, campaign_run_id string, config_hash string")
    ledger = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    extract = lambda runs: runs.select(F.concat(F.lit("x"), "run_id").alias("example_id"), F.col("run_id").alias("campaign_run_id"))
    out = ds.extend_dataset(previous, ledger, extract, config_hash="h")
    assert sorted(r["example_id"] for r in out.collect()) == ["e1", "xr2"]
    with pytest.raises(ValueError):
        ds.extend_dataset(previous, ledger, extract, config_hash="other")


def test_streams_equal_batch(spark, tmp_path):
    src, out = f"{tmp_path}/src", f"{tmp_path}/out"
    rows = [(f"r{i % 30}", f"k{i % 4}", i % 9 != 0) for i in range(300)]
    df = spark.createDataFrame(rows, "campaign_run_id string, coverage_cell_key string, coverage_valid boolean")
    df.repartition(6).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = inc.run_count_stream(stream).writeStream.outputMode("complete").format("memory").queryName("runs_per_cell").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = df.where("coverage_valid").groupBy(F.col("coverage_cell_key").alias("cell_key")).agg(F.countDistinct("campaign_run_id").alias("n"))
    assert sorted(map(tuple, spark.table("runs_per_cell").collect())) == sorted(map(tuple, batch.collect()))
    runs = df.select(F.col("campaign_run_id").alias("run_id"))
    runs.repartition(5).write.parquet(f"{tmp_path}/runs")
    ledger = spark.readStream.schema("run_id string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/runs")
    for _ in range(2):  # a second start finds nothing new
        inc.featurise_new_runs(ledger, out, f"{tmp_path}/cp", lambda b: b.withColumn("feature", F.length("run_id"))).awaitTermination()
    done = spark.read.parquet(out)
    assert done.count() == 30 and done.select("run_id").distinct().count() == 30


def test_ledger_stream_drops_duplicates(spark, tmp_path):
    df = spark.sql("select concat('r', id % 5) as run_id, timestamp'2024-01-01' + make_interval(0,0,0,0,0,id) as finished_at from range(20)")
    df.write.parquet(f"{tmp_path}/in")
    stream = inc.ledger_stream(spark, f"{tmp_path}/in", df.schema)
    q = stream.writeStream.outputMode("append").format("memory").queryName("ledger_once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ledger_once").count() == 5


def test_windows_are_transformed_in_bounded_parts():
    import tracemalloc

    function = spx.spectrum_function(9, keep_power=True).func
    rng = np.random.default_rng(3)
    n = 2500
    batch = (
        pd.Series(list(rng.normal(size=(n, 81)))), pd.Series(list(rng.normal(size=(n, 81)))),
        pd.Series(np.where(np.arange(n) % 7, 1.0, 2.0)), pd.Series(np.ones(n)), pd.Series(np.full(n, 300.0)),
    )
    tracemalloc.start()
    sizes = [len(part) for part in function(iter([batch, batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 2 * n and max(sizes) * 27**2 <= spx.BATCH_CELLS
    assert peak < 60e6  # a whole batch takes about 130 MB
    parts = pd.concat(function(iter([batch])), ignore_index=True)
    single = next(function(iter([tuple(s.iloc[1777:1778] for s in batch)])))
    assert np.allclose(parts["power"][1777], single["power"][0]) and np.allclose(parts["srad"][1777], single["srad"][0])


def test_two_centres_equal_plain_sweeps(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"map_id": rng.integers(0, 25, 900), "iz": rng.integers(0, 25, 900), "ix": rng.integers(0, 32, 900)}).drop_duplicates()
    pdf["value"] = np.where(pdf.map_id < 3, 4.0, np.round(rng.gamma(1.2, 20, len(pdf)), np.where(pdf.map_id % 2, 0, 2)[0]))
    pdf = pd.concat([pdf, pd.DataFrame({"map_id": [90, 91, 91], "iz": 0, "ix": [0, 0, 1], "value": [3.0, 1.0, 9.0]})])
    got = {r["map_id"]: r for r in mp.two_centres(spark.createDataFrame(pdf)).collect()}
    assert set(got) == set(pdf.map_id)

    def percentile(v, p):
        rank = min(max(len(v) * p + 0.5, 1), len(v))
        v = sorted(v)
        return v[math.floor(rank) - 1] + (rank - math.floor(rank)) * (v[math.ceil(rank) - 1] - v[math.floor(rank) - 1])

    for key, group in pdf.groupby("map_id"):
        v = group.value.to_numpy()
        c1, c2 = percentile(v, 0.25), percentile(v, 0.75)
        for _ in range(20):
            first = np.abs(v - c1) <= np.abs(v - c2)
            new = (np.median(v[first]), np.median(v[~first]) if (~first).any() else c2)
            c1, c2, moved = *new, new != (c1, c2)
            if not moved:
                break
        assert (got[key]["low_centre"], got[key]["high_centre"]) == pytest.approx((min(c1, c2), max(c1, c2))), key


def test_mean_does_not_depend_on_the_order_of_rows(spark):
    from fieldgrain.functions.semantics import steady_mean

    values = [0.1, 0.2, 0.3, 123.45, 560.21, 2.11, 1e-3, 77.7]
    means = set()
    for turn in range(len(values)):
        rows = spark.createDataFrame([(v,) for v in values[turn:] + values[:turn]], "value double").coalesce(1)
        means.add(rows.agg(steady_mean("value")).first()[0])
    assert len(means) == 1 and means.pop() == pytest.approx(sum(values) / len(values))
    odd = spark.createDataFrame([(1, float("inf")), (1, 2.0), (2, None), (3, 4.25), (3, None), (4, 1e300)], "k int, value double")
    got = {r[0]: r[1] for r in odd.groupBy("k").agg(steady_mean("value")).collect()}
    assert got == {1: float("inf"), 2: None, 3: 4.25, 4: 1e300}
