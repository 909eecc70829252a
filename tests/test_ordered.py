"""Blocked scans against brute force, with one hot key and blocks far smaller than it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumatable.operators import config, ordered, runs


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(600) < 0.4, 0, rng.integers(1, 6, 600))
    pdf = pd.DataFrame({"run": keys, "pos": rng.permutation(2000)[:600], "x": rng.normal(size=600).round(3)})
    pdf["phase"] = rng.choice(["a", "b", "c"], 600)
    pdf.loc[(pdf["run"] == 3) & (pdf["phase"] == "a"), "phase"] = "c"
    pdf.loc[pdf["run"] == 4, "phase"] = "c"
    pdf = pdf.sort_values(["run", "pos"]).reset_index(drop=True)
    return pdf, spark.createDataFrame(pdf).repartition(5)


def collected(df, names):
    return df.toPandas().sort_values(["run", "pos"])[names].reset_index(drop=True)


def test_running(log):
    pdf, df = log
    known = F.when(F.col("phase") == "a", F.col("x"))
    specs = {"top": ("max", F.col("x")), "total": ("sum", F.col("x")), "seen": ("last", known)}
    got = collected(ordered.running(df, ["run"], "pos", specs, block=7), list(specs))
    grouped = pdf.groupby("run")["x"]
    assert np.allclose(got["top"], grouped.cummax())
    assert np.allclose(got["total"], grouped.cumsum())
    want = pdf["x"].where(pdf["phase"] == "a").groupby(pdf["run"]).ffill()
    assert np.allclose(got["seen"], want, equal_nan=True)


def test_numbered_and_new_bests(log):
    pdf, df = log
    got = collected(ordered.numbered(df, ["run"], "pos", "n", block=11), ["n"])
    assert (got["n"] == pdf.groupby("run").cumcount() + 1).all()
    before = pdf.groupby("run")["x"].transform(lambda s: s.cummax().shift(fill_value=-1.0).clip(lower=-1.0))
    assert runs.new_bests(df, "run", "pos", "x").count() == int((pdf["x"] > before).sum())


@pytest.mark.parametrize("block,fan", [(5, 3), (64, 2), (None, 4096)])
def test_ema(log, block, fan):
    pdf, df = log
    got = collected(ordered.ema(df, ["run"], "pos", {"e": "x"}, 0.9, block=block, fan=fan), ["e"])
    want = pdf.groupby("run")["x"].transform(lambda s: s.ewm(alpha=0.1, adjust=False).mean())
    assert np.allclose(got["e"], want, atol=1e-12)


def test_top_rows_and_global_index(log):
    pdf, df = log
    got = ordered.top_rows(df, ["run"], [F.col("pos").desc()], 9, spread=["pos"], salts=4).toPandas()
    want = pdf.groupby("run").tail(9)
    assert sorted(zip(got["run"], got["pos"])) == sorted(zip(want["run"], want["pos"]))
    indexed = ordered.global_index(df, ["pos"]).toPandas().sort_values("pos")
    assert (indexed["index"].to_numpy() == np.arange(600)).all()


def test_phase_tail(log):
    pdf, df = log
    got = runs.phase_tail(df, "run", "phase", "pos", 6, ("a", "b")).toPandas()
    for run, rows in pdf.groupby("run"):
        phase = next((p for p in ("a", "b") if (rows["phase"] == p).any()), None)
        want = (rows if phase is None else rows[rows["phase"] == phase]).tail(6)
        mine = got[got["run"] == run]
        assert sorted(mine["pos"]) == sorted(want["pos"])
        assert all((p is None and phase is None) or p == phase for p in mine["sampled_phase"])


def test_flatten_later_branch_wins(spark):
    text = '{"a": {"k": 1, "deep": {"k": 2, "z": "x"}}, "b": {"k": 3, "empty": {}}, "top": "{not json"}'
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = {row["key"]: row["value"] for row in config.flatten_json(df, "id", "text").collect()}
    assert got == {"k": "3", "z": "x", "top": "{not json"}


def test_flatten_any_depth_and_quoted_objects(spark):
    text = '{"a":{"b":{"c":{"d":{"e":{"f":5}}}}},"q":"{\\"b\\":1}","n":null,"l":[1,{"x":2}],"s":"t"}'
    df = spark.createDataFrame([(1, text)], "id int, text string")
    got = {row["key"]: row["value"] for row in config.flatten_json(df, "id", "text").collect()}
    assert got["f"] == "5" and got["q"] == '{"b":1}' and got["s"] == "t" and got["n"] is None
    assert "b" not in got and "x" not in got


@pytest.mark.parametrize("spread", ["sparse", "clustered"])
def test_hot_run_on_any_spread_of_positions(spark, spread):
    """One run holds nearly all rows; positions are far apart, or crowded with a few far away."""
    rng = np.random.default_rng(7)
    n = 3000
    places = rng.choice(10**12, n, replace=False) if spread == "sparse" else np.concatenate([np.arange(n - 5), 10**14 * np.arange(1, 6)])
    pdf = pd.DataFrame({"run": "hot", "pos": np.sort(places), "x": rng.normal(size=n)})
    pdf = pd.concat([pdf, pd.DataFrame({"run": [f"r{i}" for i in range(40)], "pos": 10**13, "x": 1.0})], ignore_index=True)
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(5)
    cuts = ordered.splitters(df, ["run"], "pos", 100)
    blocks = df.where("run = 'hot'").groupBy(ordered.block_of(["run"], "pos", cuts).alias("b")).count().collect()
    assert 25 <= len(blocks) <= 32 and max(r["count"] for r in blocks) < 300
    want = pdf.sort_values(["run", "pos"]).reset_index(drop=True)
    for decay, block in ((0.5, 100), (0.001, 500)):  # one chunk a block; fourteen
        got = collected(ordered.ema(df, ["run"], "pos", {"e": "x"}, decay, block=block, fan=4), ["run", "pos", "e"])
        truth = want.groupby("run")["x"].transform(lambda s, d=decay: s.ewm(alpha=1 - d, adjust=False).mean())
        assert np.allclose(got["e"], truth, atol=1e-12)
    top = collected(ordered.running(df, ["run"], "pos", {"m": ("max", F.col("x")), "s": ("sum", F.lit(1))}, block=100), ["m", "s"])
    assert np.allclose(top["m"], want.groupby("run")["x"].cummax())
    assert (top["s"] == want.groupby("run").cumcount() + 1).all()


def test_flatten_keeps_order_and_spelling(spark):
    """Inner branches win by their place in the text, not by name; numbers stay as written."""
    text = '{"x":{"b":{"k":1},"a":{"k":2}},"f":1.50,"e":1e3,"big":123456789012345678901,"t":true,"l":[1.0,"é"],"k":{"z":null}}'
    rows = [(1, text), (2, "[1]"), (3, "nope"), (4, None), (5, "{}"), (6, '{"a":NaN}'), (7, "{" + '"a":{' * 900 + '"d":1' + "}" * 901)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {(r["id"], r["key"]): r["value"] for r in config.flatten_json(df, "id", "text").collect()}
    assert got == {
        (1, "k"): "2", (1, "f"): "1.50", (1, "e"): "1e3", (1, "big"): "123456789012345678901", (1, "t"): "true",
        (1, "l"): '[1.0,"é"]', (1, "z"): None, (7, "d"): "1",
    }


def test_facts_reach_every_row_of_a_hot_key(spark):
    rows = spark.range(500).selectExpr("if(id < 400, 'hot', concat('r', id)) as run", "id as pos")
    facts = rows.groupBy("run").agg(F.max("pos").alias("last"))
    got = ordered.join_facts(rows, facts, ["run"], ["pos"], salts=4)
    assert got.count() == 500 and got.where("run = 'hot' and last = 399").count() == 400
    assert got.columns == ["run", "pos", "last"]


def test_averages_have_no_python_walk(log, capsys):
    _, df = log
    ordered.ema(df, ["run"], "pos", {"e": "x"}, 0.9, block=50).explain()
    plan = capsys.readouterr().out
    assert "MapInPandas" not in plan and "FlatMapGroupsInPandas" not in plan


def test_average_leaves_blanks_out(spark):
    rows = [("r", k, v) for k, v in enumerate([None, 1.0, None, 3.0, 5.0])]
    df = spark.createDataFrame(rows, "run string, pos bigint, v double")
    got = {row["pos"]: row["e"] for row in ordered.ema(df, ["run"], "pos", {"e": "v"}, 0.98).collect()}
    want = {1: 1.0, 3: 0.98 + 0.02 * 3.0, 4: 0.98 * (0.98 + 0.06) + 0.02 * 5.0}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
