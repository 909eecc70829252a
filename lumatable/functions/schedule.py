"""Noise schedule and timestep weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Schedule length, cap on a single beta, offset of the squared cosine.
TRAIN_STEPS = 1000
MAX_BETA = 0.999
COSINE_OFFSET = 0.008


def _level(step: Column, total: int) -> Column:
    angle = (step / F.lit(float(total)) + COSINE_OFFSET) / (1.0 + COSINE_OFFSET) * (math.pi / 2.0)
    return F.pow(F.cos(angle), F.lit(2.0))


def schedule(spark: SparkSession, total: int = TRAIN_STEPS) -> DataFrame:
    """Dimension table (t, beta, alphas_cumprod, snr): always `total` rows, so safe to broadcast."""
    step = F.col("t").cast("double")
    beta = F.least(F.lit(MAX_BETA), 1.0 - _level(step + 1.0, total) / _level(step, total))
    order = Window.partitionBy(F.lit(0)).orderBy("t")
    return (
        spark.range(total)
        .select(F.col("id").cast("int").alias("t"))
        .withColumn("beta", beta)
        .withColumn("alphas_cumprod", F.exp(F.sum(F.log(1.0 - F.col("beta"))).over(order)))
        .withColumn("snr", snr(F.col("alphas_cumprod")))
    )


def snr(level: Column) -> Column:
    return F.pow(F.sqrt(level) / F.sqrt(1.0 - level), F.lit(2.0))


def min_snr_v(ratio: Column, gamma: float = 5.0) -> Column:
    return F.least(ratio, F.lit(gamma)) / (ratio + 1.0)


def min_snr_epsilon(ratio: Column, gamma: float = 5.0) -> Column:
    return F.least(F.lit(1.0), F.lit(gamma) / (ratio + 1e-8))


def p2(ratio: Column, gamma: float = 1.0, k: float = 1.0) -> Column:
    return 1.0 / F.pow(F.lit(k) + F.greatest(ratio, F.lit(1e-8)), F.lit(gamma))


def edm(level: Column, sigma_data: float = 0.5) -> Column:
    sigma = F.sqrt((1.0 - level) / level)
    product = sigma * F.lit(sigma_data)
    return (sigma * sigma + sigma_data * sigma_data) / (product * product + 1e-8)


def loss_weight(scheme: str, ratio: Column, level: Column, prediction: str = "v_prediction", **options) -> Column:
    """One weight column for a named scheme."""
    name = "min_snr" if scheme.strip().lower() == "mini_snr" else scheme.strip().lower()
    if name == "min_snr":
        by_type = {"v_prediction": min_snr_v, "epsilon": min_snr_epsilon}
        if prediction not in by_type:
            raise ValueError(f"Unsupported prediction type: {prediction}")
        return by_type[prediction](ratio, **options)
    if name == "p2":
        return p2(ratio, **options)
    if name == "edm":
        return edm(level, **options)
    raise ValueError(f"Unknown weighting scheme: {scheme}")


def stage_label(step: Column, decomposition_steps: int, adapter_steps: int) -> Column:
    """Training stage of a step by two boundaries."""
    return (
        F.when(step < decomposition_steps, "stage1_decom")
        .when(step < decomposition_steps + adapter_steps, "stage2_adapter")
        .otherwise("stage3_joint")
    )
