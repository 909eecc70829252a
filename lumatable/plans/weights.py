"""Timestep weights: orders stand for training samples (timestep from the key, loss = total price)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable.functions import schedule
from lumatable.plans.registry import query, table

T_MAX = 180

LEVEL = "pow(cos((({0}) / 1000.0::DOUBLE + 0.008::DOUBLE) / 1.008::DOUBLE * (pi() / 2)), 2)"
SCHEDULE = f"""raw AS (SELECT t, least(0.999::DOUBLE, 1 - {LEVEL.format('t + 1')} / {LEVEL.format('t')}) AS beta FROM range(1000) r(t)),
levels AS (SELECT t, beta, exp(sum(ln(1 - beta)) OVER (ORDER BY t)) AS alphas_cumprod FROM raw),
schedule AS (SELECT *, pow(sqrt(alphas_cumprod) / sqrt(1 - alphas_cumprod), 2) AS snr FROM levels),
samples AS (SELECT o_orderkey, o_orderkey % 1000 AS t, o_totalprice AS loss, o_orderpriority AS priority FROM orders)"""


def samples(spark, sf):
    step = (F.col("o_orderkey") % schedule.TRAIN_STEPS).cast("int")
    return table(spark, sf, "orders").select(
        "o_orderkey", step.alias("t"), F.col("o_totalprice").alias("loss"), F.col("o_orderpriority").alias("priority")
    )


def scheduled(spark, sf):
    """Samples with their schedule row; the schedule always has 1000 rows."""
    return samples(spark, sf).join(F.broadcast(schedule.schedule(spark)), "t")


@query("q_schedule", f"""WITH {SCHEDULE} SELECT t, count(*) AS n_samples, round(beta, 8) AS beta, round(alphas_cumprod, 8) AS alphas_cumprod,
  round(snr, 6) AS snr FROM samples JOIN schedule USING (t) GROUP BY t, beta, alphas_cumprod, snr""")
def noise_schedule(spark, sf):
    used = samples(spark, sf).groupBy("t").agg(F.count(F.lit(1)).alias("n_samples"))
    return used.join(F.broadcast(schedule.schedule(spark)), "t").select(
        "t",
        "n_samples",
        F.round("beta", 8).alias("beta"),
        F.round("alphas_cumprod", 8).alias("alphas_cumprod"),
        F.round("snr", 6).alias("snr"),
    )


@query("q_snr_weights", f"""WITH {SCHEDULE} SELECT o_orderkey, round(least(snr, 5) / (snr + 1), 8) AS min_snr_v,
  round(least(1, 5 / (snr + 1e-8)), 8) AS min_snr_eps, round(1 / (1 + greatest(snr, 1e-8)), 8) AS p2,
  round(((1 - alphas_cumprod) / alphas_cumprod + 0.25) / (0.25 * (1 - alphas_cumprod) / alphas_cumprod + 1e-8), 6) AS edm
  FROM samples JOIN schedule USING (t)""")
def snr_weights(spark, sf):
    ratio, level = F.col("snr"), F.col("alphas_cumprod")
    return scheduled(spark, sf).select(
        "o_orderkey",
        F.round(schedule.loss_weight("mini_snr", ratio, level), 8).alias("min_snr_v"),
        F.round(schedule.loss_weight("min_snr", ratio, level, "epsilon"), 8).alias("min_snr_eps"),
        F.round(schedule.loss_weight("p2", ratio, level), 8).alias("p2"),
        F.round(schedule.loss_weight("edm", ratio, level), 6).alias("edm"),
    )


@query("q_weighted_loss", f"""WITH {SCHEDULE}, kept AS (SELECT *, least(snr, 5) / (snr + 1) AS w FROM samples JOIN schedule USING (t) WHERE t <= {T_MAX})
  SELECT priority, count(*) AS n_samples, round(sum(loss * w) / greatest(sum(w), 1e-8), 4) AS weighted_loss FROM kept GROUP BY priority""")
def weighted_loss(spark, sf):
    weight = schedule.min_snr_v(F.col("snr"))
    kept = scheduled(spark, sf).where(F.col("t") <= T_MAX).withColumn("w", weight)
    mean = F.sum(F.col("loss") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-8))
    return kept.groupBy("priority").agg(F.count(F.lit(1)).alias("n_samples"), F.round(mean, 4).alias("weighted_loss"))
