"""Streaming queries over the event log; the stream's result is read back as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable.plans.registry import query
from lumatable.plans.runs import LOG
from lumatable.streaming import monitor


def events(spark, sf):
    return monitor.stream_table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("phase"),
        F.col("value").alias("metric"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


@query("q_stream_log", "SELECT user_id AS run, event_id AS pos, event_type AS phase, value AS metric FROM events")
def stream_log(spark, sf):
    return monitor.append_to_parquet(events(spark, sf).drop("ts"), "stream-log")


@query("q_stream_latest", f"""WITH {LOG} SELECT run, pos, phase, loss AS metric FROM (SELECT *,
  row_number() OVER (PARTITION BY run ORDER BY pos DESC) AS rn FROM log) WHERE rn = 1""")
def stream_latest(spark, sf):
    latest = monitor.latest_status(events(spark, sf).drop("ts"), "run", "pos")
    return monitor.newest(monitor.updates_to_parquet(latest, "stream-latest"), ["run"])


@query("q_stream_best", f"""WITH {LOG}, seen AS (SELECT run, pos, loss, coalesce(max(loss) OVER (PARTITION BY run ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best_before FROM log)
  SELECT run, pos, loss AS metric, best_before FROM seen WHERE loss > best_before""")
def stream_best(spark, sf):
    return monitor.running_bests(events(spark, sf).select("run", "pos", "metric"))


@query("q_stream_ema", f"""WITH {LOG} SELECT run, pos, round(list_reduce(list(loss) OVER (PARTITION BY run ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: 0.98::DOUBLE * a + (1 - 0.98::DOUBLE) * x), 6) AS ema FROM log""")
def stream_ema(spark, sf):
    averages = monitor.running_ema(events(spark, sf).select("run", "pos", "metric"))
    return averages.withColumn("ema", F.round("ema", 6))


@query("q_stream_window", """SELECT user_id AS run, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS window_start, count(*) AS n_rows,
  round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2""")
def stream_window(spark, sf):
    windows = monitor.windowed_throughput(events(spark, sf), "run", "ts", "metric")

    table = monitor.newest(monitor.updates_to_parquet(windows, "stream-window"), ["run", "window_start"])
    # Wall-clock seconds, whatever the session's time zone.
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", epoch, F.col("window_start").cast("timestamp_ntz"))
    return table.select("run", seconds.alias("window_start"), "n_rows", F.round("mean_value", 6).alias("mean_value"))
