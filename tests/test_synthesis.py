"""Whole degradation and night synthesis against a per-image NumPy walk over the same draws."""

import hashlib
import math

import numpy as np
import pytest
from conftest import image_rows, planes
from pyspark.sql import functions as F
from test_pixels import both_axes, correlate_axis, gauss, motion_kernel, reflect

from lumatable.operators import degrade, night, pixels, runs
from lumatable.operators.catalog import CLASS_GROUPS

RNG = np.random.default_rng(5)
SHAPES = [(60, 52), (9, 12), (10, 10)]
RGB8 = [RNG.integers(0, 256, (*s, 3)) for s in SHAPES]
RGB8[2][:] = 0  # all black


def unit(ident, label, seed=42):
    return int(hashlib.md5(f"{ident}:{seed}:{label}".encode()).hexdigest()[:8], 16) / 2**32


def between(ident, label, low, high):
    return low + unit(ident, label) * (high - low)


def normal(ident, label):
    return math.sqrt(-2 * math.log(1 - unit(ident, label + "/1"))) * math.cos(2 * math.pi * unit(ident, label + "/2"))


def poisson(ident, label, mean):
    target, term, n, total, step = unit(ident, label), math.exp(-mean), 0, math.exp(-mean), 0
    while total <= target and step < 400:
        n, step = n + 1, step + 1
        term *= mean / step
        total += term
    return n


def hsv8(rgb):
    r, g, b = (int(v) for v in rgb)
    top, low = max(r, g, b), min(r, g, b)
    spread = top - low
    sat = np.rint(255.0 * 4096 / top) if top else 0
    hue = np.rint(180.0 * 4096 / (6.0 * spread)) if spread else 0
    turn = g - b if top == r else b - r + 2 * spread if top == g else r - g + 4 * spread
    h = (int(turn * hue) + 2048) >> 12
    return (h + 180 if h < 0 else h), (int(spread * sat) + 2048) >> 12, top


def from_hsv(h, s, v):
    """Sector form of HSV to RGB, hue in degrees."""
    place = (h / 60.0) % 6.0
    sector, part = int(math.floor(place)), place - math.floor(place)
    p, q, t = v * (1 - s), v * (1 - s * part), v * (1 - s * (1 - part))
    return [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)][sector]


def clip8(value):
    return np.floor(np.clip(value, 0, 255))


def degraded(ident, image, p, soften):
    h, w, _ = image.shape
    area = min(1.0, h * w / 512**2)
    most = 1 if area < 0.35 else 2 if area < 0.75 else 4
    mask = np.zeros((h, w))
    for i in range(1, int(unit(ident, "lights") * (most + 1)) + 1):
        part = {k: between(ident, f"light/{i}/{k}", *r) for k, r in degrade.LIGHT.items()}
        for y in range(h):
            for x in range(w):
                d = ((x - part["cx"] * w) / max(part["rx"] * w, 1)) ** 2 + ((y - part["cy"] * h) / max(part["ry"] * h, 1)) ** 2
                mask[y, x] = max(mask[y, x], math.exp(-d * part["sharpness"]) * part["intensity"])
    if soften:
        for axis, side in ((1, w), (0, h)):
            mask = correlate_axis(mask, degrade.SMALL_KERNELS[int(side * 0.04) | 1], axis, "reflect")
        mask = np.clip(mask, 0, 1)
    dark = np.zeros((h, w, 3))
    for y in range(h):
        for x in range(w):
            hue, sat, top = hsv8(image[y, x])
            v, glow = top / 255.0, mask[y, x] * p["headlight_boost"]
            final = v ** p["gamma"] * p["linear_attenuation"] * (1 - glow) + v * glow
            back = from_hsv(hue * 2.0, clip8(sat * p["saturation_factor"]) / 255.0, clip8(final * 255) / 255.0)
            r, g, b = (np.rint(c * 255.0) for c in back)
            shift = p["color_shift_factor"] * (1 - mask[y, x]) * np.clip(1 - final, 0, 1) * 255
            dark[y, x] = clip8(np.array([r - shift * 0.5, g, b + shift]))
    if p["use_vignette"]:
        for y in range(h):
            for x in range(w):
                d = ((x - w / 2) ** 2 + (y - h / 2) ** 2) / ((w / 2) ** 2 + (h / 2) ** 2)
                dark[y, x] = clip8(dark[y, x] * np.clip(1 - p["vignette_strength"] * d, 0, 1))
    if p["use_motion_blur"]:
        kernel = motion_kernel(p["motion_blur_kernel"], p["motion_blur_angle"])
        n, moved = len(kernel), np.zeros_like(dark)
        for y in range(h):
            for x in range(w):
                for j in range(n):
                    for i in range(n):
                        moved[y, x] += kernel[j, i] * dark[reflect(y + j - n // 2, h), reflect(x + i - n // 2, w)]
        dark = np.rint(moved)
    for c, name in enumerate(("dr", "dg", "db")):
        sigma = p["noise_sigma_read"] * between(ident, f"sigma/{name}", 0.8, 1.2)
        for y in range(h):
            for x in range(w):
                place = f"{name}/{y}/{x}"
                shot = poisson(ident, f"shot/{place}", dark[y, x, c] * p["noise_k"]) / p["noise_k"]
                dark[y, x, c] = clip8(shot + normal(ident, f"read/{place}") * sigma)
    luma = np.array([0.299, 0.587, 0.114])
    return guard(image, dark, (dark @ luma).mean() / max((image @ luma).mean(), 1.0), 0.10, 0.55, True)


def guard(source, dark, ratio, low, high, eight):
    if ratio < low:
        alpha = min(1.0, (low - ratio) / low)
        dark = dark * (1 - alpha) + source * alpha * 0.35
    elif ratio > high:
        dark = dark * (high / max(ratio, 1e-6))
    return clip8(dark) if eight else np.clip(dark, 0, 1)


@pytest.mark.parametrize("use_blur", [0, 1])
def test_degrade(spark, use_blur):
    changes = {"use_vignette": 1, "vignette_strength": 0.4, "use_motion_blur": use_blur, "motion_blur_angle": 30.0}
    result = degrade.degrade(image_rows(spark, RGB8), degrade.fixed_params(changes))
    got = planes(result, degrade.DARK, len(RGB8))
    params = {**degrade.FIXED_PARAMS, **changes}
    for i, image in enumerate(RGB8):
        want = degraded(i, image, params, True)
        for c, name in enumerate(degrade.DARK):
            off = np.abs(got[name][i] - want[..., c])
            # Truncation may move a value that sits on a whole number by one.
            assert off.max() <= 1 and (off > 0).mean() < 0.01


def test_drawn_parameters_stay_in_range(spark):
    params = degrade.draw_params(F.col("id"), {"gamma": (2.0, 2.5)})
    df = spark.range(5000).select(*[v.alias(n) for n, v in params.items()])
    low = df.agg(*[F.min(c).alias(c) for c in df.columns]).first()
    high = df.agg(*[F.max(c).alias(c) for c in df.columns]).first()
    assert set(df.columns) == set(degrade.PARAMS)
    assert 2.0 <= low["gamma"] and high["gamma"] < 2.5
    assert (low["motion_blur_kernel"], high["motion_blur_kernel"]) == (3, 9)
    assert df.where(F.col("motion_blur_kernel") % 2 == 0).count() == 0
    assert (low["jpeg_quality"], high["jpeg_quality"]) == (40, 85)
    assert abs(df.agg(F.avg("use_motion_blur")).first()[0] - 0.2) < 0.03


# --- night -------------------------------------------------------------------

NIGHT_SHAPES = [(16, 20), (12, 12)]
SOURCE = [np.floor(RNG.random((*s, 3)) * 255) / 255 for s in NIGHT_SHAPES]
LABELS = [RNG.choice([7, 11, 19, 20, 21, 23, 24, 26, 0], s) for s in NIGHT_SHAPES]
LABELS[0][:6] = 23  # a sky that counts
LABELS[1][LABELS[1] == 23] = 7  # no sky


def to_hsv(rgb):
    r, g, b = rgb
    top, low, eps = max(rgb), min(rgb), 1.1920929e-07
    scale = 60.0 / (top - low + eps)
    h = (g - b) * scale if top == r else (b - r) * scale + 120 if top == g else (r - g) * scale + 240
    return (h + 360 if h < 0 else h), (top - low) / (top + eps), top


def soft(a, sigma):
    return both_axes(a, gauss(max(3, round(sigma * 4) | 1), sigma), "reflect")


def night_image(ident, src, labels, randomize, sky=None):
    h, w, _ = src.shape
    side, yy = max(h, w), (np.arange(h) / (h - 1))[:, None]
    m = {g: np.isin(labels, ids).astype(float) for g, ids in CLASS_GROUPS["labelIds"].items()}
    working = src.copy()
    if labels[0, 0] == 23:
        if sky is None:
            grad = np.array(night.SKY_TOP) * (1 - yy[..., None]) + np.array(night.SKY_BOTTOM) * yy[..., None]
            sky = np.repeat(grad, w, axis=1)
            if randomize:
                stars = np.zeros((h, w))
                for y in range(h):
                    for x in range(w):
                        stars[y, x] = unit(ident, f"star/{y}/{x}") < 0.0009
                        for c in range(3):
                            sky[y, x, c] = np.clip(sky[y, x, c] + normal(ident, f"sky{c}/{y}/{x}") * 0.006, 0, 1)
                sky = np.clip(sky + both_axes(stars, gauss(5, 1.3), "reflect")[..., None] * np.array(night.STAR_COLOUR), 0, 1)
        else:
            under = m["sky"] > 0.05
            scale = np.clip(np.maximum(src[under].mean(0), 0.03) / np.maximum(sky[under].mean(0), 1e-4), 0.20, 0.55)
            sky = np.clip(sky * scale * np.array(night.ASSET_TINT), 0, 1)
        alpha = soft(m["sky"], side * 0.01)[..., None]
        working = np.clip(working * (1 - alpha) + sky * alpha, 0, 1)
    maps = [np.full((h, w), v) for v in night.BASE_SETTING]
    for group, *targets in night.CLASS_SETTINGS:
        s = soft(m[group], side * 0.01)
        maps = [a * (1 - s) + t * s for a, t in zip(maps, targets)]
    dark = np.zeros_like(src)
    for y in range(h):
        for x in range(w):
            hue, sat, val = to_hsv(working[y, x])
            sat = np.clip(sat * maps[2][y, x], 0, 1)
            val = np.clip(np.clip(val, 0, 1) ** maps[0][y, x] * maps[1][y, x], 0, 1)
            dark[y, x] = np.clip(from_hsv(hue, sat, val), 0, 1)
    focus = np.clip(m["road"] + 0.8 * m["light"] + 0.45 * m["vehicle"] + 0.15 * m["sign"], 0, 1)
    pool = soft(focus, max(3.0, 0.022 * side)) * np.clip(0.20 + 0.80 * yy**1.8, 0, 1)
    pool = np.clip(pool * (between(ident, "pool", 0.7, 1.0) if randomize else 1.0), 0, 1)
    near = np.clip(0.10 + 0.90 * yy**1.6, 0, 1)
    influence = np.clip(m["road"] + 0.45 * m["building"] + 0.35 * m["vehicle"], 0, 1)
    road = soft(m["road"] * near, side * 0.012) * np.clip(pool * 1.2 + 0.25 * m["vehicle"], 0, 1)
    light = (pool * influence * near)[..., None] * np.array([0.08, 0.06, 0.03]) + road[..., None] * np.array([0.12, 0.10, 0.08])
    light[..., 2] += soft(m["sky"], side * 0.05) * 0.015 * (1 - 0.55 * yy)
    lit = np.clip(dark + np.clip(light, 0, 0.16), 0, 1)
    glow = soft(np.clip(m["light"] + 0.5 * m["sign"] + 0.25 * m["vehicle"], 0, 1), side * 0.008)[..., None] * 0.22
    out = np.clip(lit * (1 - glow) + np.maximum(lit, src) * glow, 0, 1)
    luma = np.array([0.299, 0.587, 0.114])
    return guard(src, out, (out @ luma).mean() / max((src @ luma).mean(), 1e-6), 0.08, 0.60, False)


def labelled(spark):
    images = image_rows(spark, SOURCE)
    labels = spark.createDataFrame(
        [(i, y, x, int(v)) for i, a in enumerate(LABELS) for (y, x), v in np.ndenumerate(a)],
        "image_id bigint, y int, x int, label_id int",
    )
    return images.select("image_id", "h", "w"), pixels.rgb_pixels(pixels.by_image(images)).join(labels, ["image_id", "y", "x"])


@pytest.mark.parametrize("randomize,tile", [(True, 256), (False, 5)])
def test_night(spark, randomize, tile):
    images, px = labelled(spark)
    got = planes(night.synthesize(px, images, randomize=randomize, tile=tile), degrade.DARK, len(SOURCE))
    for i, (src, labels) in enumerate(zip(SOURCE, LABELS)):
        want = night_image(i, src, labels, randomize)
        for c, name in enumerate(degrade.DARK):
            assert np.abs(got[name][i] - want[..., c]).max() < 1e-9


def test_night_with_an_asset(spark):
    images, px = labelled(spark)
    asset = RNG.random((7, 9, 3))
    rows = image_rows(spark, [asset])
    assets = pixels.rgb_pixels(rows).withColumnRenamed("image_id", "asset_id").withColumn("asset_id", F.lit(0))
    got = planes(night.synthesize(px, images, randomize=False, assets=assets, n_assets=1), degrade.DARK, len(SOURCE))
    fitted = pixels.rgb_pixels(rows)
    sky = planes(pixels.resize(fitted, F.lit(16), F.lit(20), list("rgb")), list("rgb"), 1)
    want = night_image(0, SOURCE[0], LABELS[0], False, np.stack([sky[c][0] for c in "rgb"], axis=-1))
    for c, name in enumerate(degrade.DARK):
        assert np.abs(got[name][0] - want[..., c]).max() < 1e-9


def test_skies_attached_to_image_rows(spark):
    """The same images as with asset pixels; an image whose asset has no pixels gets the rendered sky."""
    asset = RNG.random((7, 9, 3))
    assets = pixels.rgb_pixels(image_rows(spark, [asset])).withColumnRenamed("image_id", "asset_id").withColumn("asset_id", F.lit(0))
    images, _ = labelled(spark)
    labels = spark.createDataFrame(
        [(i, y, x, int(v)) for i, a in enumerate(LABELS) for (y, x), v in np.ndenumerate(a)], "image_id bigint, y int, x int, label_id int"
    )
    for n_assets in (1, 50):
        rows = night.with_assets(pixels.by_image(image_rows(spark, SOURCE)), assets, n_assets)
        with_sky = {r["image_id"] for r in rows.where("sky is not null").select("image_id").collect()}
        px = pixels.rgb_pixels(rows, also={"sky_": "sky"}).join(labels, ["image_id", "y", "x"])
        got = planes(night.synthesize(px, images, randomize=False), degrade.DARK, len(SOURCE))
        for i, (src, label) in enumerate(zip(SOURCE, LABELS)):
            sky = None
            if i in with_sky:
                h, w = src.shape[:2]
                fitted = planes(pixels.resize(pixels.rgb_pixels(image_rows(spark, [asset])), F.lit(h), F.lit(w), list("rgb")), list("rgb"), 1)
                sky = np.stack([fitted[c][0] for c in "rgb"], axis=-1)
            want = night_image(i, src, label, False) if sky is None else night_image(i, src, label, False, sky)
            for c, name in enumerate(degrade.DARK):
                assert np.abs(got[name][i] - want[..., c]).max() < 1e-9
        assert (n_assets == 1) == (len(with_sky) == len(SOURCE))


def test_a_label_outside_the_space_fails(spark):
    images, px = labelled(spark)
    wrong = px.withColumn("label_id", F.when((F.col("y") == 1) & (F.col("x") == 1), 77).otherwise(F.col("label_id")))
    with pytest.raises(Exception, match="Unsupported label .*77"):
        night.synthesize(wrong, images, randomize=False).collect()


def test_a_broken_image_is_counted_and_fails_nothing(spark):
    whole = [(i, 2, 2, [float(10 * i + k) for k in range(12)], 1) for i in range(3)]
    broken = [(3, 2, 2, [1.0] * 11, 1), (4, 2, 2, None, 1), (5, 0, 2, [], 1), (6, 2, 2, [1.0] * 11 + [None], 1), (7, 2, 2, [1.0] * 12, 0)]
    df = spark.createDataFrame(whole + broken, "image_id bigint, h int, w int, data array<double>, ok int")
    done, outcome = degrade.degrade_batch(df, degrade.fixed_params())
    assert {r["image_id"] for r in done.select("image_id").distinct().collect()} == {0, 1, 2} and done.count() == 12
    errors = {r["image_id"]: r["error"] for r in outcome.collect()}
    assert errors == {0: None, 1: None, 2: None, 3: "expected 12 values, found 11", 4: "no data", 5: "no pixels", 6: "missing values", 7: "not decoded"}
    summed = runs.job_outcome(outcome, [], F.col("ok"), F.lit(2.0)).first()
    assert (summed["processed"], summed["failed"], summed["succeeded"], summed["items_per_sec"]) == (8, 5, 3, 4.0)


def test_the_guard_does_not_depend_on_the_order_of_pixels(spark):
    """A source of 160 lifts a dark 56 to just 56: floating sums of the lumas cut it to 55 in one order, to 56 in another."""
    weights, rows, want = np.array([299, 587, 114]), [], {}
    for seed in (1, 4, 6, 7, 8, 10):
        rng, n = np.random.default_rng(seed), 24
        source, dark = rng.integers(100, 256, (n, 3)), rng.integers(0, 25, (n, 3))
        source[0], dark[0] = (160, 100, 140), (56, 35, 49)
        ratio = (int((dark @ weights).sum()) / n / 1000) / (int((source @ weights).sum()) / n / 1000)
        for order in range(12):
            ident = 100 * seed + order
            want[ident] = guard(source[0].astype(float), dark[0].astype(float), ratio, 0.10, 0.55, True).astype(int).tolist()
            places = np.random.default_rng(1000 + order).permutation(n)
            rows += [(ident, int(p), *map(int, source[p]), *map(int, dark[p])) for p in places]
    px = spark.createDataFrame(rows, "image_id bigint, p int, r int, g int, b int, dr int, dg int, db int").repartition(1)
    got = {row["image_id"]: [row[c] for c in degrade.DARK] for row in degrade.exposure_guard(px).where("p = 0").collect()}
    assert got == want


def test_the_night_is_one_pass_over_strips(spark, capsys):
    """Stars are blurred together with the other maps, so pixels become strips once."""
    images, px = labelled(spark)
    result = night.synthesize(px, images)
    capsys.readouterr()
    result.explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1
