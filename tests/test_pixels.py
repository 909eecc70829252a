"""Pixel operators and metrics against NumPy on images of different shapes."""

import math

import numpy as np
import pytest
from conftest import image_rows, planes
from pyspark.sql import functions as F

from lumatable.operators import augment, components, pixels, quality

RNG = np.random.default_rng(11)
SHAPES = [(8, 8), (16, 20), (5, 9), (1, 4)]
A = [RNG.random(s) for s in SHAPES]
B = [RNG.random(s) for s in SHAPES]


def reflect(i, n):
    if n == 1:
        return 0
    i %= 2 * (n - 1)
    return i if i < n else 2 * (n - 1) - i


def correlate_axis(a, taps, axis, border):
    out, r, n = np.zeros_like(a), len(taps) // 2, a.shape[axis]
    for o in range(n):
        for j, k in enumerate(taps):
            p = o + j - r
            if border == "zero" and not 0 <= p < n:
                continue
            out_index = [slice(None)] * 2
            in_index = [slice(None)] * 2
            out_index[axis], in_index[axis] = o, reflect(p, n) if border != "zero" else p
            out[tuple(out_index)] += k * a[tuple(in_index)]
    return out


def both_axes(a, taps, border):
    return correlate_axis(correlate_axis(a, taps, 1, border), taps, 0, border)


def gauss(n, sigma):
    k = np.exp(-((np.arange(n) - (n - 1) / 2) ** 2) / (2 * sigma**2))
    return k / k.sum()


@pytest.fixture(scope="module")
def gray(spark):
    return pixels.gray_pixels(pixels.by_image(image_rows(spark, A)))


@pytest.fixture(scope="module")
def pairs(spark):
    left = image_rows(spark, A).withColumnRenamed("data", "a")
    right = image_rows(spark, B).select("image_id", F.col("data").alias("b"))
    return pixels.pair_pixels(pixels.by_image(left.join(right, "image_id")))


def per_image(df, name):
    return {r["image_id"]: r[name] for r in df.collect()}


def close(got, want, tol=1e-10):
    for a, b in zip(got, want):
        assert a.shape == b.shape and np.abs(a - b).max() < tol


def test_blur_with_sigma_per_shape(spark, gray):
    sigma = F.greatest("h", "w") * 0.15
    soft = pixels.gaussian_blur(gray, sigma, ["v"])
    want = []
    for a in A:
        s = max(a.shape) * 0.15
        want.append(both_axes(a, gauss(max(3, round(s * 4) | 1), s), "reflect"))
    close(planes(soft, ["v"], len(A))["v"], want)


@pytest.mark.parametrize("target", [(8, 8), (3, 7), (30, 21), (1, 1)])
def test_resize(gray, target):
    def axis(n, size):
        m = np.zeros((size, n))
        for o in range(size):
            p = max((o + 0.5) * n / size - 0.5, 0)
            i = min(int(p), n - 1)
            m[o, i] += 1 - (p - i)
            m[o, min(i + 1, n - 1)] += p - i
        return m

    got = planes(pixels.resize(gray, F.lit(target[0]), F.lit(target[1]), ["v"]), ["v"], len(A))["v"]
    close(got, [axis(a.shape[0], target[0]) @ a @ axis(a.shape[1], target[1]).T for a in A])


def test_resize_to_same_size_is_identity(gray):
    close(planes(pixels.resize(gray, F.col("h"), F.col("w"), ["v"]), ["v"], len(A))["v"], A)


def rotated(a, degrees):
    t, (h, w) = math.radians(degrees), a.shape
    cy, cx = (h - 1) / 2, (w - 1) / 2
    out = np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            sx = (x - cx) * math.cos(t) - (y - cy) * math.sin(t) + cx
            sy = (x - cx) * math.sin(t) + (y - cy) * math.cos(t) + cy
            for iy in (math.floor(sy), math.floor(sy) + 1):
                for ix in (math.floor(sx), math.floor(sx) + 1):
                    if 0 <= iy < h and 0 <= ix < w:
                        out[y, x] += a[iy, ix] * (1 - abs(sy - iy)) * (1 - abs(sx - ix))
    return out


@pytest.mark.parametrize("degrees", [0.0, 4.0, -5.0, 90.0, 33.0])
def test_rotate(gray, degrees):
    got = planes(pixels.rotate(gray, F.lit(degrees), ["v"]), ["v"], len(A))["v"]
    close(got, [rotated(a, degrees) for a in A])


def test_quarter_turn_is_counter_clockwise(gray):
    got = planes(pixels.rotate(gray, F.lit(90.0), ["v"]), ["v"], len(A))["v"][0]
    assert np.abs(got - np.rot90(A[0])).max() < 1e-10


def motion_kernel(n, degrees):
    """Horizontal line kernel rotated about its centre by bilinear sampling, then normalised."""
    line = np.zeros((n, n))
    line[n // 2] = 1.0 / n
    c, t, out = n // 2, math.radians(degrees), np.zeros((n, n))
    for y in range(n):
        for x in range(n):
            sx = math.cos(t) * (x - c) - math.sin(t) * (y - c) + c
            sy = math.sin(t) * (x - c) + math.cos(t) * (y - c) + c
            for iy in (math.floor(sy), math.floor(sy) + 1):
                for ix in (math.floor(sx), math.floor(sx) + 1):
                    if 0 <= iy < n and 0 <= ix < n:
                        out[y, x] += line[iy, ix] * (1 - abs(sy - iy)) * (1 - abs(sx - ix))
    return out / (out.sum() + 1e-8)


@pytest.mark.parametrize("size,degrees", [(3, 0.0), (5, 37.0), (9, 120.0)])
def test_motion_blur(spark, size, degrees):
    rows = image_rows(spark, A).withColumn("taps", pixels.motion_taps(F.lit(size), F.lit(degrees)))
    px = pixels.gray_pixels(pixels.by_image(rows), keep=["taps"]).withColumn("tag", F.col("y") * 100 + F.col("x"))
    got = planes(pixels.correlate(px, "taps", ["v"], carry=["tag"]), ["v", "tag"], len(A))
    kernel, want, r = motion_kernel(size, degrees), [], size // 2
    for a in A:
        h, w = a.shape
        out = np.zeros_like(a)
        for y in range(h):
            for x in range(w):
                for j in range(size):
                    for i in range(size):
                        out[y, x] += kernel[j, i] * a[reflect(y + j - r, h), reflect(x + i - r, w)]
        want.append(out)
    close(got["v"], want)
    close(got["tag"], [np.add.outer(np.arange(a.shape[0]) * 100, np.arange(a.shape[1])).astype(float) for a in A])


def test_ssim(pairs):
    taps, got = gauss(11, 1.5), per_image(quality.ssim(pairs), "ssim")
    for i, (a, b) in enumerate(zip(A, B)):
        ma, mb = both_axes(a, taps, "zero"), both_axes(b, taps, "zero")
        va, vb = both_axes(a * a, taps, "zero") - ma**2, both_axes(b * b, taps, "zero") - mb**2
        cov = both_axes(a * b, taps, "zero") - ma * mb
        value = (2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4))
        assert got[i] == pytest.approx(value.mean(), abs=1e-12)


def test_identical_images(pairs):
    same = pairs.withColumn("b", F.col("a"))
    assert all(v == pytest.approx(1.0) for v in per_image(quality.ssim(same), "ssim").values())
    assert set(per_image(quality.psnr(same), "psnr").values()) == {None}


def test_edge_wavelet_frequency_tv(pairs, gray):
    edge, wavelet = per_image(quality.edge(pairs), "edge"), per_image(quality.wavelet(pairs), "wavelet")
    freq, tv = per_image(quality.frequency(pairs), "frequency"), per_image(quality.total_variation(gray, "v"), "tv")

    def magnitude(a):
        gx = correlate_axis(correlate_axis(a, [-1, 0, 1], 1, "zero"), [1, 2, 1], 0, "zero")
        gy = correlate_axis(correlate_axis(a, [1, 2, 1], 1, "zero"), [-1, 0, 1], 0, "zero")
        return np.sqrt(gx**2 + gy**2 + 1e-6)

    for i, (a, b) in enumerate(zip(A, B)):
        assert edge[i] == pytest.approx(np.abs(magnitude(a) - magnitude(b)).mean(), abs=1e-12)
        spectrum = [np.log1p(np.abs(np.fft.rfft2(v, norm="ortho"))) for v in (a, b)]
        assert freq[i] == pytest.approx(np.abs(spectrum[0] - spectrum[1]).mean(), abs=1e-12)
        h, w = a.shape
        if h > 1:
            d = (a - b)[: h - h % 2, : w - w % 2]
            p, q, r, s = d[::2, ::2], d[::2, 1::2], d[1::2, ::2], d[1::2, 1::2]
            bands = np.abs([(p + q - r - s) / 2, (p - q + r - s) / 2, (p - q - r + s) / 2])
            assert wavelet[i] == pytest.approx(bands.mean(), abs=1e-12)
            want = np.abs(np.diff(a, axis=0)).mean() + np.abs(np.diff(a, axis=1)).mean()
            assert tv[i] == pytest.approx(want, abs=1e-12)


def test_pooled_psnr_is_not_the_mean(pairs):
    batches = {r["batch"]: r for r in quality.pooled_psnr(quality.squared_error(pairs), "image_id", 2).collect()}
    for batch in (0, 1):
        error = np.concatenate([((A[i] - B[i]) ** 2).ravel() for i in (2 * batch, 2 * batch + 1)])
        assert batches[batch]["psnr"] == pytest.approx(10 * math.log10(1 / error.mean()))


def test_retinex_without_high_side(pairs):
    one = pairs.withColumns({"low": F.col("a"), "r_low": F.col("b"), "i_low": F.col("a")})
    empty = one.withColumns({n: F.lit(None).cast("double") for n in ("high", "r_high", "i_high")})
    row = quality.retinex_terms(empty).where("image_id = 1").first()
    want = np.abs(B[1] * A[1] - A[1]).mean()
    assert row["retinex_total"] == pytest.approx(want) and row["l_recon_high"] == 0 and row["l_exposure"] == 0


def test_augment_moves_both_sides_alike(pairs):
    same = pairs.where("image_id < 2").withColumn("b", F.col("a") * 2.0)
    moved = augment.augment(same, 6, ["a", "b"])
    assert moved.count() == 72
    assert moved.where(F.abs(F.col("b") - F.col("a") * 2.0) > 1e-12).count() == 0
    twice = pixels.hflip(pixels.hflip(same))
    assert twice.exceptAll(same).count() == 0


def flood(mask):
    seen, sizes = np.zeros_like(mask, dtype=bool), []
    for start in zip(*np.nonzero(mask)):
        if seen[start]:
            continue
        stack, size = [start], 0
        seen[start] = True
        while stack:
            y, x = stack.pop()
            size += 1
            for j in range(max(0, y - 1), min(mask.shape[0], y + 2)):
                for i in range(max(0, x - 1), min(mask.shape[1], x + 2)):
                    if mask[j, i] and not seen[j, i]:
                        seen[j, i] = True
                        stack.append((j, i))
        sizes.append(size)
    return sorted(sizes)


@pytest.mark.parametrize("tile", [3, 256])
def test_components(spark, tile):
    masks = [RNG.random(s) < d for s, d in (((17, 23), 0.3), ((12, 12), 0.45), ((9, 30), 0.6))]
    snake = np.zeros((15, 15), dtype=bool)
    snake[::2] = True
    snake[1::4, -1] = snake[3::4, 0] = True
    masks.append(snake)
    rows = [(i, int(y), int(x)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    found = components.components(spark.createDataFrame(rows, "image_id int, y int, x int"), tile).toPandas()
    for i, mask in enumerate(masks):
        assert sorted(found[found["image_id"] == i]["size"]) == flood(mask)


def test_one_component_over_many_strips(spark):
    """A spiral that winds through every strip many times, beside a straight line; pixels come twice."""
    side = 41
    grid = np.zeros((side, side), dtype=bool)
    y = x = 0
    dy, dx, turns = 0, 1, 0
    grid[0, 0] = True
    while turns < 2:
        ny, nx = y + dy, x + dx
        ahead = (ny + dy, nx + dx)
        blocked = not (0 <= ny < side and 0 <= nx < side) or grid[ny, nx]
        blocked = blocked or (0 <= ahead[0] < side and 0 <= ahead[1] < side and grid[ahead])
        if blocked:
            dy, dx, turns = dx, -dy, turns + 1
            continue
        y, x, turns = ny, nx, 0
        grid[y, x] = True
    rows = [(1, int(j), int(i)) for j, i in zip(*np.nonzero(grid))] + [(2, 7, i) for i in range(500)]
    df = spark.createDataFrame(rows * 2, "image_id int, y int, x int")
    strips = components.strip_components(df, 2)
    assert strips.count() == 21 + 1
    found = components.components(df, 2).collect()
    assert sorted((r["image_id"], r["size"]) for r in found) == [(1, s) for s in flood(grid)] + [(2, 500)]
    assert flood(grid) == [int(grid.sum())]


def test_frequency_of_a_large_pair_and_shrunk(spark):
    rng = np.random.default_rng(5)
    images = [rng.random((2, 512, 512)) for _ in range(2)]
    rows = [(k, 512, 512, a.reshape(-1).tolist(), b.reshape(-1).tolist()) for k, (a, b) in enumerate(images)]
    both = spark.createDataFrame(rows, "image_id bigint, h int, w int, a array<double>, b array<double>").repartition(2, "image_id")
    px = both.select("image_id", "h", "w", F.posexplode(F.arrays_zip("a", "b")).alias("p", "v")).select(
        "image_id", "h", "w", F.floor(F.col("p") / 512).cast("int").alias("y"), (F.col("p") % 512).alias("x"), "v.a", "v.b"
    )

    def level(a):
        return np.log1p(np.abs(np.fft.rfft2(a, norm="ortho")))

    got = {r["image_id"]: r["frequency"] for r in quality.frequency(px).collect()}
    for k, (a, b) in enumerate(images):
        assert abs(got[k] - np.abs(level(a) - level(b)).mean()) < 1e-9
    small = px.where((F.col("y") < 32) & (F.col("x") < 32)).withColumns({"h": F.lit(32), "w": F.lit(32)})
    assert quality.frequency(small, size=16).count() == 2
