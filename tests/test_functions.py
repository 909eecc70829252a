import math

from pyspark.sql import functions as F
import pytest

from lumatable.functions import colour, draws, parsing, paths, schedule
from lumatable.operators import catalog


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


def test_safe_numbers(spark):
    texts = ["", "None", None, "8.0", "8.7", "-8.7", " 3 ", "1e3", "abc", "8d", "1f", "nan", "inf", ".5", "5."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(parsing.safe_float(F.col("t")).alias("f"), parsing.safe_int(F.col("t")).alias("i")).collect()
    assert [r["i"] for r in rows] == [None, None, None, 8, 8, -8, 3, 1000, None, None, None, None, None, 0, 5]
    floats = [r["f"] for r in rows]
    assert floats[:3] == [None] * 3 and floats[3:6] == [8.0, 8.7, -8.7] and floats[8:11] == [None] * 3
    assert floats[11] != floats[11] and floats[12] == float("inf")


@pytest.mark.parametrize("value,digits", [(0.125, 2), (74.25, 1), (2.675, 2), (-0.5, 0), (1e9 / 3, 4), (float("nan"), 2)])
def test_number_text(spark, value, digits):
    want = "-" if value != value else f"{value:.{digits}f}"
    assert one(spark, parsing.number_text(F.col("x"), digits), x=value) == want


def test_names_and_steps(spark):
    items = parsing.list_items(F.lit("LPIPS, psnr  other,NIQE psnr"))
    assert one(spark, parsing.metric_names(items)) == ["psnr", "ssim", "lpips", "niqe"]
    steps = parsing.step_counts(F.array(F.lit(8), F.lit(0), F.lit(20), F.lit(8)), F.lit(4))
    assert one(spark, steps) == [8, 20, 4]
    assert one(spark, parsing.weighting_scheme(F.lit(" Mini_SNR "))) == "min_snr"
    assert one(spark, parsing.preset_path(F.lit("max"))) == "configs/train/max.yaml"
    assert one(spark, parsing.preset_path(F.lit("max_accum"))) is None
    with pytest.raises(Exception, match="Unsupported split"):
        one(spark, parsing.require_known(F.col("s"), paths.SPLITS, "split"), s="other")


def test_durations(spark):
    assert one(spark, parsing.duration_text(F.lit(3661.9))) == "01:01:01"
    assert one(spark, parsing.duration_text(F.lit(-5.0))) == "00:00"
    assert one(spark, parsing.duration_text(F.lit(None).cast("double"))) == "-"


def test_paths(spark):
    path = F.lit("/d/leftImg8bit/train/aachen/a_0.b_leftImg8bit.png")
    assert one(spark, paths.tree_sample_id(path, "/d")) == "aachen__a_0.b_leftImg8bit"
    assert one(spark, paths.tree_sample_id(F.lit("/d/train"), "/d")) == "train"
    assert one(spark, paths.checkpoint_step(F.lit("checkpoint-120"))) == 120
    assert one(spark, paths.checkpoint_step(F.lit("checkpoint-x"))) is None
    assert one(spark, paths.shard_sample_id(F.lit("val"), F.lit(3), F.lit(7))) == "val__shard03__row00007"


def test_draws_are_repeatable_and_spread(spark):
    df = spark.range(20000).select(
        draws.unit(F.col("id"), "u").alias("u"),
        draws.normal(F.col("id"), "n").alias("n"),
        draws.poisson(F.col("id"), "p", F.lit(4.0)).alias("p"),
        draws.whole_between(F.col("id"), "w", 3, 5).alias("w"),
    )
    means = df.agg(*[F.avg(c).alias(c) for c in "unpw"], F.variance("p").alias("vp"), F.stddev("n").alias("sn")).first()
    assert abs(means["u"] - 0.5) < 0.01 and abs(means["n"]) < 0.03 and abs(means["sn"] - 1) < 0.02
    assert abs(means["p"] - 4) < 0.06 and abs(means["vp"] - 4) < 0.15 and abs(means["w"] - 4) < 0.02
    assert df.repartition(7).agg(F.sum("u")).first()[0] == pytest.approx(df.agg(F.sum("u")).first()[0])


def test_colour_round_trips(spark):
    px = spark.range(4096).select(*[(F.pmod(F.col("id") * k, F.lit(256)) / 255.0).alias(c) for c, k in zip("rgb", (7, 31, 101))])
    h, s, v = colour.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    back = px.select("r", "g", "b", *[c.alias(n) for c, n in zip(colour.hsv_to_rgb(h, s, v), ("r2", "g2", "b2"))])
    worst = back.select(*[F.max(F.abs(F.col(c) - F.col(f"{c}2"))) for c in "rgb"]).first()
    assert max(worst) < 1e-5
    eight = px.select(*[F.rint(F.col(c) * 255).cast("int").alias(c) for c in "rgb"])
    parts = colour.rgb8_to_hsv8(F.col("r"), F.col("g"), F.col("b"))
    top = eight.select(F.min(parts[0]), F.max(parts[0]), F.max(parts[1]), F.max(parts[2])).first()
    assert top[0] >= 0 and top[1] <= 180 and top[2] <= 255 and top[3] <= 255


def test_schedule(spark):
    import math

    def level(t):
        return math.cos((t + 0.008) / 1.008 * math.pi / 2) ** 2

    want, product = [], 1.0
    for i in range(1000):
        product *= 1 - min(1 - level((i + 1) / 1000) / level(i / 1000), 0.999)
        want.append(product)
    got = [r["alphas_cumprod"] for r in schedule.schedule(spark).orderBy("t").collect()]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))


def test_poisson_of_large_means(spark):
    from lumatable.functions import draws

    for mean in (0.0, 3.0, 800.0, 2000.0):
        df = spark.range(400).select(draws.poisson(F.col("id"), "p", F.lit(mean)).alias("n"))
        got = [row["n"] for row in df.collect()]
        average = sum(got) / len(got)
        assert abs(average - mean) <= 5 * max(mean, 1e-9) ** 0.5 / 20
        assert mean == 0 or 0.6 * mean < sum((g - average) ** 2 for g in got) / len(got) < 1.5 * mean


def test_preset_names_in_the_summary(spark):
    import pytest

    from lumatable.operators import config

    args = [({"config": "small"},), ({"config": "a/b/own.yaml", "config_name": "given"},), ({"config": ""},), ({"mode": "train"},)]
    df = spark.createDataFrame(args, "args map<string,string>")
    got = [(r["config_name"], r["config_path"]) for r in config.runtime_summary(df, "args", []).collect()]
    assert got == [("small", "configs/train/small.yaml"), ("given", "a/b/own.yaml"), (None, ""), (None, None)]
    removed = spark.createDataFrame([({"config": "max_accum"},)], "args map<string,string>")
    with pytest.raises(Exception, match="Please use 'max'"):
        config.runtime_summary(removed, "args", []).collect()


def test_distinct_labels_hold_every_value(spark):
    rows = [(1, v) for v in (0, 63, 64, 127, 128, 191, 192, 255, 5, 5)] + [(2, v) for v in (-1, 300, 77)] + [(3, None)]
    df = spark.createDataFrame(rows, "image_id int, label_id int").repartition(3)
    got = {r["image_id"]: r["labels"] for r in catalog.distinct_labels(df, "image_id").collect()}
    assert got == {1: [0, 5, 63, 64, 127, 128, 191, 192, 255], 2: [-1, 77, 300], 3: []}
    bad = {r["image_id"]: (r["n_invalid"], r["invalid"]) for r in catalog.invalid_labels(df, catalog.TRAIN_IDS, "image_id", shown=2).collect()}
    assert bad[1] == (6, "63,64") and bad[2] == (3, "-1,77") and 3 not in bad


def test_label_maps_shuffle_one_row_per_image(spark, capsys):
    df = spark.range(1000).selectExpr("id % 3 as image_id", "cast(id % 40 as int) as label_id")
    catalog.invalid_labels(df, catalog.TRAIN_IDS, "image_id").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "hashpartitioning(image_id" in plan


def test_poisson_walks_no_further_than_the_draw(spark):
    """Every walk holds the step that passes its draw, and ordinary draws from 8-bit signals take some ten steps, not fifty."""
    targets = [0.0, 1e-9, 0.01, 0.3, 0.5, 0.9, 0.999, 1 - 1e-6, 1 - 2**-31, 1 - 2**-32]
    means = [0.0, 1e-6, 0.02, 0.7, 2.5, 5.1, 10.2, 60.0, 700.0]
    df = spark.createDataFrame([(t, m) for t in targets for m in means], "t double, m double")
    for row in df.select("t", "m", draws.poisson_steps(F.col("t"), F.col("m")).alias("steps")).collect():
        term = total = math.exp(-row["m"])
        n = 0
        while total <= row["t"]:
            n += 1
            term *= row["m"] / n
            total += term
        assert n + 2 <= row["steps"]
    signals = spark.range(10000).select(draws.unit(F.col("id"), "t").alias("t"), (F.col("id") % 256 * 0.02).alias("m"))
    assert signals.agg(F.avg(draws.poisson_steps(F.col("t"), F.col("m")))).first()[0] < 12
