"""Stencils give the same results when an image is cut into many strips."""

import re

import numpy as np
import pytest
import test_pixels as whole
from conftest import image_rows, planes
from pyspark.sql import functions as F

from lumatable.operators import pixels, quality, strips
from test_pixels import gray, pairs  # noqa: F401  (fixtures)

BIG = np.random.default_rng(5).random((512, 512))
OTHER = np.clip(BIG + np.random.default_rng(6).normal(0, 0.1, BIG.shape), 0, 1)


@pytest.fixture
def small(monkeypatch):
    """Two lines a strip for all but the smallest test images."""
    monkeypatch.setattr(strips, "CELLS", 24)


def test_stencils_over_many_strips(spark, small, gray, pairs):  # noqa: F811
    whole.test_blur_with_sigma_per_shape(spark, gray)
    whole.test_motion_blur(spark, 9, 120.0)
    whole.test_ssim(pairs)
    whole.test_edge_wavelet_frequency_tv(pairs, gray)
    whole.test_retinex_without_high_side(pairs)


@pytest.mark.parametrize("lines", [24, 1 << 17])
def test_metrics_of_image_rows_in_one_pass(spark, monkeypatch, lines):
    monkeypatch.setattr(strips, "CELLS", lines)
    left = image_rows(spark, whole.A).withColumnRenamed("data", "a")
    right = image_rows(spark, whole.B).select("image_id", F.col("data").alias("b"))
    rows = left.join(right, "image_id")
    names = ["psnr", "charbonnier", "ssim", "wavelet", "edge", "frequency"]
    got = {r["image_id"]: r for r in quality.score(rows, names).collect()}
    px = pixels.pair_pixels(rows)
    for name, one in {
        "psnr": quality.psnr, "charbonnier": quality.charbonnier, "ssim": quality.ssim,
        "wavelet": quality.wavelet, "edge": quality.edge, "frequency": quality.frequency,
    }.items():
        for image, value in whole.per_image(one(px), name).items():
            assert got[image][name] == pytest.approx(value, abs=1e-12), (name, image)


def test_composite_shrinks_before_the_frequency_term(spark):
    rows = spark.createDataFrame([(0, 12, 12, BIG[:12, :12].ravel().tolist(), OTHER[:12, :12].ravel().tolist())],
                                 "image_id bigint, h int, w int, a array<double>, b array<double>")
    weights = {"frequency": 0.5}
    unit = {n: (F.col(n) + 1.0) / 2.0 for n in ("a", "b")}
    got = quality.composite(rows, weights, frequency_size=6).first()
    want = quality.frequency(pixels.pair_pixels(rows).withColumns(unit), size=6).first()["frequency"]
    assert got["frequency"] == pytest.approx(want)
    assert got["total"] == pytest.approx(got["char"] + 0.1 * got["ssim"] + 0.5 * want)
    assert quality.composite(rows, weights).first()["frequency"] != pytest.approx(want)
    with pytest.raises(ValueError, match="Unsupported"):
        quality.score(rows, ["niqe"])


def test_a_large_image_is_many_strips(spark):
    rows = spark.createDataFrame(
        [(0, 512, 512, BIG.ravel().tolist(), OTHER.ravel().tolist())], "image_id bigint, h int, w int, a array<double>, b array<double>"
    )
    assert strips.of_images(rows, ["a", "b"], 5, cells=1 << 14).count() == 16
    taps = whole.gauss(11, 1.5)
    ma, mb = whole.both_axes(BIG, taps, "zero"), whole.both_axes(OTHER, taps, "zero")
    va, vb = whole.both_axes(BIG**2, taps, "zero") - ma**2, whole.both_axes(OTHER**2, taps, "zero") - mb**2
    cov = whole.both_axes(BIG * OTHER, taps, "zero") - ma * mb
    want = ((2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4))).mean()
    assert quality.ssim(rows).first()["ssim"] == pytest.approx(want, abs=1e-12)
    px = pixels.gray_pixels(rows, "a")
    soft = pixels.gaussian_blur(px, F.lit(5.12), ["v"])
    sides = whole.gauss(21, 5.12)
    whole.close(planes(soft, ["v"], 1)["v"], [whole.both_axes(BIG, sides, "reflect")])


def test_rows_do_not_grow_with_the_kernel(spark):
    px = pixels.gray_pixels(image_rows(spark, [BIG[:64, :64]]))
    for sigma in (1.0, 8.0):
        stripped = strips._cells(px, {"v": F.col("v")}, pixels.blur_reach(F.lit(sigma)), ["image_id"], [], [], None)
        assert stripped.count() == 1
        assert pixels.gaussian_blur(px, F.lit(sigma), ["v"]).count() == 64 * 64


def test_inputs_of_a_stencil_are_not_shuffled(spark, capsys):
    """What is dealt out behind a stencil is coordinates, carried columns and results, not the cells it was made from."""
    rows = spark.createDataFrame([(1, 4, 4, [float(v) for v in range(48)])], "image_id bigint, h int, w int, data array<double>")
    px = pixels.rgb_pixels(pixels.by_image(rows, 2))
    px = pixels.separable(px, np.array([0.25, 0.5, 0.25]), ["r"], "reflect", carry=["g"], deal=2)
    px.explain(mode="formatted")
    dealt = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: (.*)", capsys.readouterr().out)
    assert any("_o_r" in columns for columns in dealt) and not any("_cells#" in columns for columns in dealt)
