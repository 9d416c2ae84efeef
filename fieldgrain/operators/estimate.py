"""End-to-end prediction: samples to features to quantile to speed maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fieldgrain.operators import models, patches as pt, spectrum as spx
from fieldgrain.operators.curves import truth_quantile, with_speed
from fieldgrain.operators.registry import SPECTRAL_FEATURES


def window_features(pixels: DataFrame, samples: DataFrame, window: int, stride: int) -> DataFrame:
    """Features, curve and truth of every window of every sample, keyed by example id."""
    members = pt.grid_members(pixels, samples, window, stride)
    features = spx.patch_features(pt.patch_arrays(members, ["frequency_hz"]), window)
    truth = pt.patch_truth(members).join(pt.patch_purity(members), pt.PATCH, "left")
    return features.join(truth, pt.PATCH, "left").withColumn("example_id", pt.example_id())


def with_target(features: DataFrame, frequency: str = "frequency_hz") -> DataFrame:
    return truth_quantile(features, F.col(frequency), F.col("truth_cs_center_m_s"))


def predict_maps(features: DataFrame, model, predictors: list[str] = SPECTRAL_FEATURES, *, truth: Column | None = None,
                 frequency: str = "frequency_hz") -> DataFrame:
    """Quantile, wavenumber and speed of every window, with its place in the sample's map; unusable windows stay as rows."""
    scored = models.score_valid(features, model, predictors)
    speed = with_speed(scored, F.col("q_pred"), truth if truth is not None else F.lit(None).cast("double"), frequency)
    known = [F.col("target_q").alias("q_true")] if "target_q" in features.columns else []
    return speed.select(
        *known, "sample_id", "example_id", F.col("cz").alias("map_z"), F.col("cx").alias("map_x"), "prediction_valid", "q_pred",
        "k_pred_rad_m", "cs_pred_m_s", "cs_true_m_s", "cs_error_m_s", "cs_error_percent", "cs_absolute_error_percent", "sws_valid",
    )
