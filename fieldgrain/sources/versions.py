"""Append-only versions: numbered JSON documents of which each appears whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession


class VersionTaken(RuntimeError):
    """Another writer has published this number first."""


def _hadoop(spark: SparkSession, folder: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return context, path, path.getFileSystem(context._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Published numbers, ascending; a folder that does not exist has none."""
    _, path, files = _hadoop(spark, folder)
    if not files.exists(path):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))


def _file(folder: str, version: int) -> str:
    return f"{folder}/v{version:08d}.json"


def publish(spark: SparkSession, folder: str, version: int, body: Mapping) -> None:
    """Write the document beside its place and rename it there, which fails where the number is taken.

    The rename is atomic on file systems such as HDFS; object stores need a committer that makes it so.
    """
    context, path, files = _hadoop(spark, folder)
    jvm = context._jvm
    files.mkdirs(path)
    unseen = jvm.org.apache.hadoop.fs.Path(f"{folder}/_{uuid.uuid4().hex}")
    out = files.create(unseen)
    out.write(json.dumps({**body, "version": version}, sort_keys=True).encode())
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(_file(folder, version))
    no_option = context._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), context._jsc.hadoopConfiguration()).rename
    try:
        rename(files.makeQualified(unseen), files.makeQualified(target), no_option)
    except Exception as error:
        if files.exists(target):
            files.delete(unseen, False)
            raise VersionTaken(f"version {version} of {folder} exists") from error
        raise


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> dict | None:
    """The newest document, or the one with the given number; None where nothing was published."""
    known = versions(spark, folder)
    if version is None:
        if not known:
            return None
        version = known[-1]
    if version not in known:
        raise ValueError(f"no version {version} in {folder}")
    return json.loads(spark.read.option("wholetext", True).text(_file(folder, version)).first()["value"])
