"""The training study: broken contracts stop it, scores are out of fold, tables equal pandas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldgrain.operators import training as tr


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [
        (float(x), float(z), 0.3 + 0.02 * float(x) + 0.01 * float(z) + float(e), "train" if i % 4 else "test", i % 3 + 1, "hot" if i % 3 else None, i % 5)
        for i, (x, z, e) in enumerate(zip(rng.normal(size=240), rng.normal(size=240), rng.normal(scale=0.01, size=240)))
    ]
    return spark.createDataFrame(data, "x double, z double, y double, partition string, cv_fold int, k string, m int").cache()


@pytest.mark.parametrize(
    ("predictors", "word"),
    [(["x", "x"], "duplicated"), (["x", "w"], "missing"), (["x", "k"], "nonnumeric"), (["x", "truth_a"], "forbidden"), (["x", "h"], "not finite"), ([], "no predictors")],
)
def test_contract_stops_the_fit(rows, predictors, word):
    wide = rows.withColumn("truth_a", F.col("y")).withColumn("h", F.when(F.col("m") > 0, F.col("x")))
    with pytest.raises(tr.ContractBroken, match=word):
        tr.training_study(wide, "ridge", predictors, "y", {"k": ["k"]}, 3)


@pytest.mark.parametrize(("kind", "options"), [("ridge", {"penalty": 0.0}), ("bagged_trees", {"trees": 8, "depth": 5})])
def test_tables_equal_the_scored_rows(rows, kind, options):
    groupings = {"k": ["k"], "m": ["m"], "km": ["k", "m"]}
    scored, model, tables = tr.training_study(rows, kind, ["x", "z"], "y", groupings, 3, **options)
    pdf = scored.toPandas()
    assert len(pdf) == 240 and set(pdf[pdf.partition == "train"].prediction_source) == {"out_of_fold"}
    pdf["e"] = pdf.q_pred - pdf.y
    got = {(r.table_name, r.partition, r.level_1, r.level_2): r for r in tables.collect()}
    text = {"k": pdf.k.where(pdf.k.notna(), None), "m": pdf.m.astype(str)}
    seen = 0
    for name, columns in groupings.items():
        first, second = text[columns[0]], text[columns[1]] if len(columns) > 1 else None
        keys = [(p, a, second.iloc[i] if second is not None else None) for i, (p, a) in enumerate(zip(pdf.partition, first))]
        for key in set(keys):
            e = pdf.e[[k == key for k in keys]]
            r = got[(name, *key)]
            assert (r.row_count, r.q_mae, r.q_rmse, r.q_bias) == pytest.approx((len(e), e.abs().mean(), np.sqrt((e**2).mean()), e.mean()))
            seen += 1
    assert seen == len(got)
    fixed = (pdf.y - pdf.y.mean()).abs().mean()
    assert pdf.e.abs().mean() < fixed
