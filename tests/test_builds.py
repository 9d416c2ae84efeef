"""Dataset builds and model versions: refusals, replays, interrupted and competing writers."""

import pytest
from pyspark.sql import functions as F

from fieldgrain.operators import model_store as ms
from fieldgrain.operators.models import RidgeModel
from fieldgrain.sources import builds as bd
from fieldgrain.sources.versions import VersionTaken, publish, read_version, versions

LEDGER = "run_id string, hash_sha256 string"


def two_each(runs):
    return runs.select(F.explode(F.sequence(F.lit(1), F.lit(2))).alias("patch"), "run_id").where("run_id <> 'empty'")


def test_build_append_replay_and_refusals(spark, tmp_path):
    folder = f"{tmp_path}/d"
    first = spark.createDataFrame([("a", "1"), ("a", "1"), ("empty", "2"), (None, "3")], LEDGER)
    more = spark.createDataFrame([("a", "1"), ("b", "4"), ("empty", "2")], LEDGER)
    one = bd.build_dataset(first, folder, two_each, {"window": 9, "dataset_id": "x"})
    assert (one["version"], one["run_count"], one["example_count"]) == (1, 2, 2)
    two = bd.build_dataset(more, folder, two_each, {"window": 9, "dataset_id": "y"})
    assert (two["version"], two["run_count"], two["example_count"]) == (2, 3, 4)
    assert bd.build_dataset(more, folder, two_each, {"window": 9})["version"] == 2
    with pytest.raises(bd.BuildRefused):
        bd.build_dataset(more, folder, two_each, {"window": 8})
    with pytest.raises(bd.BuildRefused):  # a known run with another source
        bd.build_dataset(spark.createDataFrame([("a", "9")], LEDGER), folder, two_each, {"window": 9})
    with pytest.raises(bd.BuildRefused):  # two sources of a new run
        bd.build_dataset(spark.createDataFrame([("c", "5"), ("c", "6")], LEDGER), folder, two_each, {"window": 9})
    with pytest.raises(bd.BuildRefused):  # other columns
        bd.build_dataset(spark.createDataFrame([("c", "5")], LEDGER), folder, lambda r: two_each(r).withColumn("z", F.lit(1)), {"window": 9})
    assert versions(spark, f"{folder}/versions") == [1, 2]
    rows = sorted((r["run_id"], r["patch"], r["part"]) for r in bd.read_examples(spark, folder).collect())
    assert rows == [("a", 1, 1), ("a", 2, 1), ("b", 1, 2), ("b", 2, 2)]
    assert bd.read_examples(spark, folder, 1).count() == 2


def test_content_does_not_depend_on_deliveries(spark, tmp_path):
    ledger = spark.createDataFrame([(f"r{i}", str(i)) for i in range(20)], LEDGER)
    whole = bd.build_dataset(ledger, f"{tmp_path}/whole", two_each, {})
    for n in (7, 20):
        parts = bd.build_dataset(ledger.where(F.substring("run_id", 2, 9).cast("int") < n), f"{tmp_path}/parts", two_each, {})
    assert parts["content"] == whole["content"] and int(whole["content"]) > 0
    other = bd.build_dataset(ledger, f"{tmp_path}/other", lambda r: two_each(r).withColumn("patch", F.col("patch") + 1), {})
    assert other["content"] != whole["content"]
    texts = spark.createDataFrame([("1", "23"), ("12", "3"), (None, "-"), ("-", None)], "a string, b string").select(bd.row_text(["a", "b"]))
    assert texts.distinct().count() == 4


def test_interrupted_build_is_not_seen(spark, tmp_path):
    folder = f"{tmp_path}/d"
    ledger = spark.createDataFrame([("a", "1")], LEDGER)

    def dies(runs):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        bd.build_dataset(ledger, folder, dies, {})
    assert read_version(spark, f"{folder}/versions") is None
    assert bd.build_dataset(ledger, folder, two_each, {})["example_count"] == 2
    assert bd.read_examples(spark, folder).count() == 2


def test_empty_ledger(spark, tmp_path):
    got = bd.build_dataset(spark.createDataFrame([], LEDGER), f"{tmp_path}/d", two_each, {})
    assert (got["version"], got["run_count"], got["example_count"], got["content"]) == (1, 0, 0, "0")
    assert bd.read_examples(spark, f"{tmp_path}/d").count() == 0


def test_a_number_is_published_once(spark, tmp_path):
    folder = f"{tmp_path}/v"
    publish(spark, folder, 1, {"by": "first"})
    with pytest.raises(VersionTaken):
        publish(spark, folder, 1, {"by": "second"})
    assert read_version(spark, folder) == {"by": "first", "version": 1}
    with pytest.raises(ValueError):
        read_version(spark, folder, 2)


def test_model_versions(spark, tmp_path):
    train = spark.createDataFrame([(float(i), float(i * i % 7), 2.0 * i) for i in range(30)], "x double, z double, y double")
    for penalty in (0.0, 50.0):
        model = RidgeModel.fit(train, ["x", "z"], "y", penalty)
        ms.register_model(model, str(tmp_path), "line", train, ["x", "z"], "y", penalty=penalty)
    newest, found = ms.load_registered(str(tmp_path), "line", train)
    first, _ = ms.load_registered(str(tmp_path), "line", train, 1)
    assert (newest.penalty, first.penalty, found["version"]) == (50.0, 0.0, 2)
    assert ms.registered_models(spark, str(tmp_path)).count() == 2
    with pytest.raises(ValueError):  # another type
        ms.load_registered(str(tmp_path), "line", train.withColumn("x", F.col("x").cast("int")))
    with pytest.raises(ValueError):  # a predictor is absent
        ms.load_registered(str(tmp_path), "line", train.drop("z"))
    with pytest.raises(ValueError):
        ms.load_registered(str(tmp_path), "other", train)
    with pytest.raises(ValueError):
        ms.register_model(newest, str(tmp_path), "leak", train, ["truth_q"], "y")
