"""Pixel tables of wavefield samples and their contract checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldgrain.functions.semantics import finite_columns, require_columns

PIXEL_SCHEMA = (
    "sample_id string, iz int, ix int, x_m double, z_m double, re double, im double, cs_true double, k_true double, "
    "material_id int, valid boolean"
)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixel parquet with non-finite numbers turned into NULL."""
    return finite_columns(spark.read.schema(PIXEL_SCHEMA).parquet(path))


def sample_checks(pixels: DataFrame, samples: DataFrame, *, tolerance: float = 1e-5) -> DataFrame:
    """Contract of every sample: full shape, finite field, uniform axes, and truth wavenumber 2*pi*f/c.

    Uniform spacing needs no ordering: on a uniform axis every coordinate is
    the first one plus index times spacing, so the largest deviation decides.
    """
    require_columns(pixels, ["sample_id", "iz", "ix", "x_m", "z_m", "re", "im", "cs_true", "k_true"], "pixels")
    joined = pixels.join(samples.select("sample_id", "nz", "nx", "dx_m", "dz_m", F.col("frequency_hz").alias("_f")), "sample_id")
    expected_k = F.lit(2 * math.pi) * F.col("_f") / F.when(F.col("cs_true") > 0, F.col("cs_true"))
    stats = joined.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("pixel_count"),
        F.max(F.col("nz") * F.col("nx")).cast("long").alias("expected_pixel_count"),
        F.count_if(F.col("re").isNull() | F.col("im").isNull()).alias("nonfinite_count"),
        (F.max(F.abs(F.col("x_m") - F.col("ix") * F.col("dx_m")) / F.col("dx_m"))).alias("axis_error_x"),
        (F.max(F.abs(F.col("z_m") - F.col("iz") * F.col("dz_m")) / F.col("dz_m"))).alias("axis_error_z"),
        F.max(F.abs(F.col("k_true") - expected_k) / expected_k).alias("wavenumber_error"),
    )
    ok = (
        (F.col("pixel_count") == F.col("expected_pixel_count"))
        & (F.col("nonfinite_count") == 0)
        & (F.col("axis_error_x") <= tolerance)
        & (F.col("axis_error_z") <= tolerance)
        & (F.col("wavenumber_error") <= tolerance)
    )
    return stats.withColumn("passed", F.coalesce(ok, F.lit(False)))
