"""Streams over a table that is one file or a folder of part files, with blank values."""

import numpy as np
import pytest

from lumatable.operators import ordered
from lumatable.plans import stream  # noqa: F401
from lumatable.plans.registry import QUERIES
from lumatable.streaming import monitor

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark):
    values = [None, 20.0, None, 21.0, 19.0, float("nan"), 30.0]
    start = np.datetime64("2024-01-01T00:00:00")
    rows = [
        (10 * k + run, (start + np.timedelta64(20 * k, "m")).astype("datetime64[us]").item(), run, "joint", v, "{}")
        for run in (1, 2) for k, v in enumerate(values)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("parts", [1, 3])
def test_folder_of_parts(spark, tmp_path, parts):
    rows, df = events(spark)
    df.repartition(parts, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    run = {name: QUERIES[name](spark, str(tmp_path)).collect() for name in QUERIES if name.startswith("q_stream_")}
    assert len(run["q_stream_log"]) == len(rows)
    assert {(r["run"], r["pos"]) for r in run["q_stream_latest"]} == {(1, 61), (2, 62)}
    assert sum(r["n_rows"] for r in run["q_stream_window"]) == len(rows)
    assert len(run["q_stream_window"]) == 6
    if parts == 1:  # one file is one micro-batch, so order inside a run is kept
        assert {(r["run"], r["metric"], r["best_before"]) for r in run["q_stream_best"]} == {
            (k, *pair) for k in (1, 2) for pair in ((20.0, -1.0), (21.0, 20.0), (30.0, 21.0))
        }
        assert all(r["ema"] is not None for r in run["q_stream_ema"]) and len(run["q_stream_ema"]) == 8


def hot_log(spark, folder, files, disorder):
    """One run with most rows, in as many micro-batches as files; rows come out of order by a number of places."""
    rng = np.random.default_rng(11)
    n = 400
    arrival = np.argsort(np.arange(n) + rng.uniform(0, disorder, n))
    values = rng.normal(20, 3, n)
    rows = [("hot", int(p), float(values[p])) for p in arrival] + [(f"r{k}", 7, 21.0 + k) for k in range(5)]
    names = {"hot": 0} | {f"r{k}": k + 1 for k in range(5)}
    size = -(-len(rows) // files)
    for k in range(files):
        part = [(names[run], pos, value) for run, pos, value in rows[k * size : (k + 1) * size]]
        spark.createDataFrame(part, "run bigint, pos bigint, metric double").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("run bigint, pos bigint, metric double").option("maxFilesPerTrigger", 1).parquet(folder)
    return values, stream


@pytest.mark.parametrize("files,disorder", [(1, 300), (4, 0), (5, 20)])
def test_running_figures_of_a_hot_run(spark, tmp_path, monkeypatch, files, disorder):
    """Rows late by no more than allowed give the batch answer, in however many micro-batches they come."""
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 50)
    values, stream = hot_log(spark, str(tmp_path / "log"), files, disorder)
    got = monitor.running_ema(stream, lateness=disorder).where("run = 0").orderBy("pos").collect()
    want, average = [], None
    for v in values:
        average = v if average is None else 0.98 * average + 0.02 * v
        want.append(average)
    assert [r["pos"] for r in got] == list(range(len(values)))
    assert np.allclose([r["ema"] for r in got], want)
    hits = {r["pos"]: r["best_before"] for r in monitor.running_bests(stream, lateness=disorder).where("run = 0").collect()}
    tops = np.concatenate([[-1.0], np.maximum.accumulate(values)[:-1]])
    assert hits == {k: tops[k] for k in range(len(values)) if values[k] > max(tops[k], -1.0)}


def test_rows_that_come_too_late_are_kept_apart(spark, tmp_path):
    folder, schema = str(tmp_path / "log"), "run bigint, pos bigint, metric double"
    for rows in ([(1, 1, 1.0), (1, 5, 5.0)], [(1, 2, 9.0), (1, 6, 6.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    steps = monitor.BestSoFar(spark, "late-test", 0)
    assert {(r["pos"], r["best_before"]) for r in steps.run(stream).collect()} == {(1, -1.0), (5, 1.0), (6, 5.0)}
    late = steps.late().collect()
    assert [(r["run"], r["pos"], r["metric"]) for r in late] == [(1, 2, 9.0)]
    # A micro-batch that is tried again changes nothing.
    steps.advance(spark.createDataFrame([(1, 2, 9.0), (1, 6, 6.0)], schema), 1)
    assert spark.read.schema(steps.results).parquet(f"{steps.base}/table").count() == 3
