"""Model registry: every fit is a new version under a name, and a load checks that the rows fit the model."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from fieldgrain.operators.models import load_model, save_model
from fieldgrain.operators.registry import leaking_predictors
from fieldgrain.sources.versions import publish, read_version, versions


def fingerprint(rows: DataFrame, predictors: Sequence[str]) -> str:
    """Hash over names and types of the predictors, in the order in which the model takes them."""
    types = dict(rows.dtypes)
    missing = [p for p in predictors if p not in types]
    if missing:
        raise ValueError(f"the rows lack the predictors {', '.join(missing)}")
    return hashlib.sha256(json.dumps([[p, types[p]] for p in predictors]).encode()).hexdigest()


def register_model(model, folder: str, name: str, train: DataFrame, predictors: Sequence[str], target: str, **metadata) -> int:
    """Save the model and append it to the versions of ``name``; earlier versions stay. Returns its number.

    The model's files are whole before the version that names them appears.
    """
    leaks = leaking_predictors(predictors)
    if leaks:
        raise ValueError(f"predictors leak the truth: {', '.join(leaks)}")
    spark = train.sparkSession
    bundle = f"{name}-{uuid.uuid4().hex}"
    save_model(model, f"{folder}/bundles", bundle, spark, **metadata)
    known = versions(spark, f"{folder}/names/{name}")
    number = known[-1] + 1 if known else 1
    body = {"name": name, "bundle": bundle, "predictors": list(predictors), "target": target, "fingerprint": fingerprint(train, predictors), "metadata": metadata}
    publish(spark, f"{folder}/names/{name}", number, body)
    return number


def load_registered(folder: str, name: str, rows: DataFrame, version: int | None = None):
    """Model and document of the newest or the given version, refused where the predictors of ``rows`` differ."""
    spark = rows.sparkSession
    found = read_version(spark, f"{folder}/names/{name}", version)
    if found is None:
        raise ValueError(f"no model {name!r} in {folder}")
    if fingerprint(rows, found["predictors"]) != found["fingerprint"]:
        raise ValueError(f"the predictors of the rows differ in type from those of model {name!r}")
    model, _ = load_model(f"{folder}/bundles", found["bundle"], spark)
    return model, found


def registered_models(spark: SparkSession, folder: str) -> DataFrame:
    """Every version of every name: one row each."""
    schema = "name string, version long, bundle string, predictors array<string>, target string, fingerprint string, metadata map<string, string>"
    return spark.read.schema(schema).json(f"{folder}/names/*/v*.json")
