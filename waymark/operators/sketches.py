"""Approximate unique users: sketches with a target error, mergeable over time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F


# Spark's largest HyperLogLog sketch has 2^21 entries.
LARGEST = 21


def sketch_size(error_probability: float) -> int:
    """log2 of the sketch entries whose relative standard error stays below the target."""
    size = max(4, math.ceil(2 * math.log2(1.04 / error_probability)))
    if size > LARGEST:
        raise ValueError(f"no sketch reaches an error of {error_probability}; the smallest is "
                         f"{1.04 / 2 ** (LARGEST / 2):.5f}")
    return size


def user_sketches(log: DataFrame, *keys: str | Column, error: float = 0.01) -> DataFrame:
    """One HyperLogLog sketch per key. Sketches are a few kilobytes whatever the traffic."""
    return log.groupBy(*keys).agg(
        F.hll_sketch_agg("user_id", F.lit(sketch_size(error))).alias("sketch"))


def merge_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Union of stored sketches, for instance of days into months."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def sketch_estimates(sketches: DataFrame) -> DataFrame:
    return sketches.withColumn("estimate", F.hll_sketch_estimate("sketch")).drop("sketch")


def approximate_unique_users(log: DataFrame, *keys: str, error: float = 0.01) -> DataFrame:
    """Estimates by HyperLogLog++, HyperLogLog and theta sketches from one scan."""
    entries = sketch_size(error)
    return log.groupBy(*keys).agg(
        F.approx_count_distinct("user_id", error).alias("hll_plus_estimate"),
        F.hll_sketch_estimate(F.hll_sketch_agg("user_id", F.lit(entries)))
        .alias("hll_estimate"),
        F.theta_sketch_estimate(F.theta_sketch_agg("user_id", F.lit(entries)))
        .alias("theta_estimate"))
