"""Colour, degradation and night-synthesis queries. An embedding's 64 values are an 8x8 plane; turned by a third and by two
thirds of its length they are the other two channels of an RGB image."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable.functions import colour
from lumatable.operators import augment, components, degrade, night, pixels
from lumatable.operators.catalog import CLASS_GROUPS, LABEL_IDS
from lumatable.plans import quality as gray_plans
from lumatable.plans.registry import query, table

SIDE = 8
TURN = SIDE * SIDE // 3  # places that a channel is turned by
RGB, DARK = degrade.RGB, degrade.DARK


def image_rows(spark, sf):
    """Interleaved RGB on [-1, 1]."""
    v, n = F.col("embedding"), F.size("embedding")
    triple = F.transform(v, lambda e, p: F.array(e, F.get(v, (p + TURN) % n), F.get(v, (p + 2 * TURN) % n)))
    data, side = F.flatten(triple), F.sqrt(n).cast("int")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), side.alias("h"), side.alias("w"), data.alias("data"), "label"
    )


def images(spark, sf):
    return pixels.by_image(image_rows(spark, sf))


def labelled(px):
    """A class label per pixel, taken from the red value."""
    return px.withColumn("label_id", (F.floor(F.abs(F.col("r")) * 1000) % 34).cast("int"))


def rgb(spark, sf):
    """Labelled pixels on [0, 1]."""
    return labelled(pixels.rgb_pixels(images(spark, sf))).withColumns({c: (F.col(c) + 1.0) / 2.0 for c in RGB})


def rgb8(spark, sf):
    return rgb(spark, sf).withColumns({c: colour.to_uint8(F.col(c) * 255.0) for c in RGB})


def night_source(spark, sf):
    """8-bit values back on [0, 1], as the synthesis reads an image."""
    return rgb8(spark, sf).withColumns({c: F.col(c) / 255.0 for c in RGB})


PX = f"""raw AS (SELECT vec_id AS image_id, p // {SIDE} AS y, p % {SIDE} AS x, embedding[p + 1]::DOUBLE AS er,
  embedding[(p + {TURN}) % {SIDE * SIDE} + 1]::DOUBLE AS eg, embedding[(p + {2 * TURN}) % {SIDE * SIDE} + 1]::DOUBLE AS eb
  FROM (SELECT vec_id, embedding, unnest(range({SIDE * SIDE})) AS p FROM embeddings)),
px AS (SELECT image_id, y, x, (er + 1) / 2 AS r, (eg + 1) / 2 AS g, (eb + 1) / 2 AS b, (floor(abs(er) * 1000)::INT % 34) AS label_id FROM raw),
px8 AS (SELECT image_id, y, x, floor(r * 255)::INT AS r, floor(g * 255)::INT AS g, floor(b * 255)::INT AS b, label_id FROM px),
src AS (SELECT image_id, y, x, r / 255 AS r, g / 255 AS g, b / 255 AS b, label_id, y / 7.0::DOUBLE AS yy FROM px8)"""


def u(ident: str, label: str) -> str:
    """A draw in SQL; label is a SQL expression."""
    return f"(('0x' || substr(md5({ident} || ':42:' || {label}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def between(ident: str, label: str, low, high) -> str:
    return f"({low}::DOUBLE + {u(ident, label)} * ({high}::DOUBLE - {low}::DOUBLE))"


def gauss(ident: str, label: str) -> str:
    first, second = u(ident, f"{label} || '/1'"), u(ident, f"{label} || '/2'")
    return f"(sqrt(-2 * ln(1 - {first})) * cos(2 * pi() * {second}))"


@query("q_pixels", f"WITH {PX} SELECT image_id, y, x, r, g, b, label_id FROM px8")
def pixel_rows(spark, sf):
    return rgb8(spark, sf).select("image_id", "y", "x", *RGB, "label_id")


@query("q_hvi", f"""WITH {PX}, l AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS i FROM px)
  SELECT image_id, y, x, round(i, 8) AS intensity, round(r - i, 8) AS chroma_r, round(b - i, 8) AS chroma_b FROM l""")
def hvi(spark, sf):
    parts = colour.hvi(*[F.col(c) for c in RGB])
    names = ("intensity", "chroma_r", "chroma_b")
    return rgb(spark, sf).select("image_id", "y", "x", *[F.round(p, 8).alias(n) for p, n in zip(parts, names)])


HSV = """CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h, d / (mx + 1.1920929e-07::DOUBLE) AS s, mx AS v
  FROM (SELECT *, CASE WHEN mx = r THEN (g - b) * 60 / (d + 1.1920929e-07::DOUBLE) WHEN mx = g THEN (b - r) * 60 / (d + 1.1920929e-07::DOUBLE) + 120
    ELSE (r - g) * 60 / (d + 1.1920929e-07::DOUBLE) + 240 END AS h0
  FROM (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS d FROM {0}))"""


def back(offset: int, h: str = "h", s: str = "s", v: str = "v") -> str:
    """One channel of HSV to RGB."""
    place = f"(({offset} + {h} / 60) - 6 * floor(({offset} + {h} / 60) / 6))"
    return f"({v} - {v} * {s} * greatest(0, least({place}, least(4 - {place}, 1))))"


HSV8 = """(CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END)::INT AS h, floor((d * st + 2048) / 4096.0)::INT AS s, mx AS v FROM (
  SELECT *, floor((turn * ht + 2048) / 4096.0)::INT AS h0 FROM (
    SELECT *, CASE WHEN mx > 0 THEN round_even(255.0::DOUBLE * 4096 / mx, 0) ELSE 0 END AS st,
      CASE WHEN d > 0 THEN round_even(180.0::DOUBLE * 4096 / (6.0 * d), 0) ELSE 0 END AS ht,
      CASE WHEN mx = r THEN g - b WHEN mx = g THEN b - r + 2 * d ELSE r - g + 4 * d END AS turn
    FROM (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS d FROM {0})))"""


@query("q_hsv", f"""WITH {PX}, f AS (SELECT image_id, y, x, {HSV.format('px')}), i AS (SELECT image_id, y, x, {HSV8.format('px8')})
  SELECT f.image_id, f.y, f.x, round(f.h, 5) AS h, round(f.s, 7) AS s, round(f.v, 8) AS v, i.h AS h8, i.s AS s8, i.v AS v8,
    round({back(5, 'f.h', 'f.s', 'f.v')}, 6) AS r_back, round_even({back(3, '(i.h * 2.0)', '(i.s / 255.0::DOUBLE)', '(i.v / 255.0::DOUBLE)')} * 255, 0)::INT AS g8_back
  FROM f JOIN i USING (image_id, y, x)""")
def hsv(spark, sf):
    h, s, v = colour.rgb_to_hsv(*[F.col(c) for c in RGB])
    eight = colour.rgb8_to_hsv8(*[F.col(f"{c}8") for c in RGB])
    px = rgb(spark, sf).withColumns({f"{c}8": colour.to_uint8(F.col(c) * 255.0) for c in RGB})
    both = px.withColumns({"h_": h, "s_": s, "v_": v, "h8": eight[0], "s8": eight[1], "v8": eight[2]})
    return both.select(
        "image_id", "y", "x", F.round("h_", 5).alias("h"), F.round("s_", 7).alias("s"), F.round("v_", 8).alias("v"),
        "h8", "s8", "v8",
        F.round(colour.hsv_to_rgb(F.col("h_"), F.col("s_"), F.col("v_"))[0], 6).alias("r_back"),
        colour.hsv8_to_rgb8(F.col("h8"), F.col("s8"), F.col("v8"))[1].alias("g8_back"),
    )


@query("q_histogram", f"""WITH {PX}, long AS (SELECT 'r' AS channel, r AS value FROM px8 UNION ALL SELECT 'g', g FROM px8 UNION ALL SELECT 'b', b FROM px8),
  bins AS (SELECT channel, value FROM (SELECT unnest(['r', 'g', 'b']) AS channel), range(256) t(value))
  SELECT b.channel, b.value, count(l.value) AS n_pixels FROM bins b LEFT JOIN long l ON l.channel = b.channel AND l.value = b.value GROUP BY 1, 2""")
def histogram(spark, sf):
    return pixels.histogram(rgb8(spark, sf))


TONE = f"""hsv AS (SELECT image_id, y, x, (x + y) / 16.0::DOUBLE AS m, {HSV8.format('px8')}),
t1 AS (SELECT image_id, y, x, m, h, floor(least(255, s * 0.6::DOUBLE)) AS s,
  pow(v / 255.0::DOUBLE, 2.5::DOUBLE) * 0.5 * (1 - m * 0.5) + v / 255.0::DOUBLE * (m * 0.5) AS vf FROM hsv),
t2 AS (SELECT *, floor(greatest(0, least(255, vf * 255))) AS v, 0.1::DOUBLE * (1 - m) * greatest(0, least(1, 1 - vf)) * 255 AS shift FROM t1),
t3 AS (SELECT image_id, y, x, shift, round_even({back(5, '(h * 2.0)', '(s / 255)', '(v / 255)')} * 255, 0) AS r,
  round_even({back(3, '(h * 2.0)', '(s / 255)', '(v / 255)')} * 255, 0) AS g, round_even({back(1, '(h * 2.0)', '(s / 255)', '(v / 255)')} * 255, 0) AS b FROM t2),
tone AS (SELECT image_id, y, x, floor(greatest(0, least(255, r - shift * 0.5)))::INT AS dr, g::INT AS dg, floor(greatest(0, least(255, b + shift)))::INT AS db FROM t3)"""


def toned(spark, sf):
    """Fixed parameters under a light mask that grows to the lower right."""
    lit = rgb8(spark, sf).withColumns(degrade.fixed_params()).withColumn("mask", (F.col("x") + F.col("y")) / 16.0)
    return degrade.tone(lit, "mask")


@query("q_tone_curve", f"WITH {PX}, {TONE} SELECT image_id, y, x, dr, dg, db FROM tone")
def tone_curve(spark, sf):
    return toned(spark, sf).select("image_id", "y", "x", *DARK)


@query("q_vignette", f"""WITH {PX}, {TONE}, f AS (SELECT *, greatest(0, 1 - 0.4::DOUBLE * ((x - 4) * (x - 4) + (y - 4) * (y - 4)) / 32.0::DOUBLE) AS k FROM tone)
  SELECT image_id, y, x, floor(dr * k)::INT AS dr, floor(dg * k)::INT AS dg, floor(db * k)::INT AS db FROM f""")
def vignette(spark, sf):
    strong = toned(spark, sf).withColumns({"use_vignette": F.lit(1), "vignette_strength": F.lit(0.4)})
    return degrade.vignette(strong).select("image_id", "y", "x", *DARK)


SCALED = PX + """, sc AS (SELECT *, floor(r * (image_id % 10) / 10.0::DOUBLE)::INT AS dr, floor(g * (image_id % 10) / 10.0::DOUBLE)::INT AS dg,
  floor(b * (image_id % 10) / 10.0::DOUBLE)::INT AS db FROM px8),
st AS (SELECT image_id, avg(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) AS sm, avg(0.299::DOUBLE * dr + 0.587::DOUBLE * dg + 0.114::DOUBLE * db) AS dm FROM sc GROUP BY image_id),
rt AS (SELECT image_id, sm, dm, dm / greatest(sm, 1.0::DOUBLE) AS ratio FROM st)"""


def scaled(spark, sf):
    """A degraded side that is the source times 0.0 to 0.9, so every branch of the guard is met."""
    return rgb8(spark, sf).withColumns({d: colour.to_uint8(F.col(c) * (F.col("image_id") % 10) / 10.0) for c, d in zip(RGB, DARK)})


@query("q_exposure_ratio", f"WITH {SCALED} SELECT image_id, round(sm, 9) AS source_mean, round(dm, 9) AS dark_mean, round(ratio, 8) AS ratio FROM rt")
def exposure_ratio(spark, sf):
    stats = degrade.exposure_stats(scaled(spark, sf))
    return stats.select(
        "image_id", F.round("source_mean", 9).alias("source_mean"), F.round("dark_mean", 9).alias("dark_mean"),
        F.round("ratio", 8).alias("ratio"),
    )


def guard_sql(s: str, d: str) -> str:
    alpha = "greatest(0, least(1, (0.1::DOUBLE - ratio) / 0.1::DOUBLE))"
    return f"""floor(greatest(0, least(255, CASE WHEN ratio < 0.1::DOUBLE THEN {d} * (1 - {alpha}) + {s} * {alpha} * 0.35::DOUBLE
      WHEN ratio > 0.55::DOUBLE THEN {d} * (0.55::DOUBLE / greatest(ratio, 1e-6::DOUBLE)) ELSE {d} END)))::INT AS {d}"""


@query("q_exposure_guard", f"WITH {SCALED} SELECT image_id, y, x, {guard_sql('r', 'dr')}, {guard_sql('g', 'dg')}, {guard_sql('b', 'db')} FROM sc JOIN rt USING (image_id)")
def exposure_guard(spark, sf):
    """The SQL adds up lumas as doubles, pixel by pixel; so do unpacked rows."""
    return degrade.exposure_guard(scaled(spark, sf), exact=False).select("image_id", "y", "x", *DARK)


DRAWN = ["gamma", "linear_attenuation", "saturation_factor", "color_shift_factor", "headlight_boost", "noise_k", "noise_sigma_read", "vignette_strength"]


@query("q_degrade_params", "SELECT doc_id AS image_id, " + ", ".join(
    f"round({between('doc_id', repr(name), *degrade.RANGES[name])}, 8) AS {name}" for name in DRAWN
) + f""", ({u('doc_id', "'vignette'")} < 0.5)::INT AS use_vignette, ({u('doc_id', "'motion_blur'")} < 0.2)::INT AS use_motion_blur,
  (3 + 2 * floor({u('doc_id', "'motion_blur_kernel'")} * 4))::INT AS motion_blur_kernel, round({between('doc_id', "'motion_blur_angle'", 0, 180)}, 8) AS motion_blur_angle,
  ({u('doc_id', "'jpeg'")} < 0.3)::INT AS use_jpeg, (40 + floor({u('doc_id', "'jpeg_quality'")} * 46))::INT AS jpeg_quality FROM documents""")
def degrade_params(spark, sf):
    params = degrade.draw_params(F.col("image_id"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"))
    return docs.select(
        "image_id", *[(F.round(v, 8) if n in DRAWN or n == "motion_blur_angle" else v).alias(n) for n, v in params.items()]
    )


@query("q_augment_params", f"""WITH d AS (SELECT doc_id AS image_id, 256 + n_chars % 100 AS h, 256 + doc_id % 50 AS w FROM documents)
  SELECT image_id, floor({u('image_id', "'crop/top'")} * (h - 256 + 1))::INT AS top, floor({u('image_id', "'crop/left'")} * (w - 256 + 1))::INT AS left,
    round({between('image_id', "'angle'", -5, 5)}, 8) AS angle, ({u('image_id', "'flip'")} > 0.5)::INT AS flip FROM d""")
def augment_params(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("image_id"), (F.col("n_chars") % 100 + 256).alias("h"), (F.col("doc_id") % 50 + 256).alias("w")
    )
    params = augment.draw_params(F.col("image_id"), F.col("h"), F.col("w"), 256)
    return docs.select("image_id", *[(F.round(v, 8) if n == "angle" else v).alias(n) for n, v in params.items()])


@query("q_augment", f"""WITH {gray_plans.PAIRS}, par AS (SELECT DISTINCT image_id, floor({u('image_id', "'crop/top'")} * 3)::INT AS top,
    floor({u('image_id', "'crop/left'")} * 3)::INT AS lft, radians({between('image_id', "'angle'", -5, 5)}) AS t, {u('image_id', "'flip'")} > 0.5 AS flip FROM pp),
  cr AS (SELECT image_id, y - top AS y, x - lft AS x, a, b FROM pp JOIN par USING (image_id) WHERE y - top BETWEEN 0 AND 5 AND x - lft BETWEEN 0 AND 5),
  src AS (SELECT image_id, flip, y, x, (x - 2.5) * sin(t) + (y - 2.5) * cos(t) + 2.5 AS sy, (x - 2.5) * cos(t) - (y - 2.5) * sin(t) + 2.5 AS sx
    FROM par, range(6) v(y), range(6) w(x)),
  taps AS (SELECT image_id, flip, y, x, floor(sy)::INT + dy AS iy, floor(sx)::INT + dx AS ix, (1 - abs(sy - floor(sy) - dy)) * (1 - abs(sx - floor(sx) - dx)) AS k
    FROM src, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx))
  SELECT t.image_id, t.y, CASE WHEN t.flip THEN 5 - t.x ELSE t.x END AS x, round(sum(coalesce(c.a, 0) * k), 6) AS a, round(sum(coalesce(c.b, 0) * k), 6) AS b
  FROM taps t LEFT JOIN cr c ON c.image_id = t.image_id AND c.y = t.iy AND c.x = t.ix GROUP BY 1, 2, 3""")
def augmented(spark, sf):
    """Crop to 6x6, rotate and flip image k and its pair k+1 together."""
    moved = augment.augment(gray_plans.pairs(spark, sf), 6, ["a", "b"])
    return moved.select("image_id", "y", "x", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("q_asset_pick", f"SELECT doc_id AS image_id, floor({u('doc_id', repr('asset'))} * 7)::INT AS asset FROM documents")
def asset_pick(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("image_id"), night.pick_asset(F.col("doc_id"), 7).alias("asset")
    )


def light_part(name: str, scale: str = "1") -> str:
    return f"{between('image_id', repr('light/1/' + name), *degrade.LIGHT[name])} * {scale}"


@query("q_light_mask", f"""WITH {PX}, n AS (SELECT vec_id AS image_id, floor({u('vec_id', repr('lights'))} * 2)::INT AS n FROM embeddings),
  l AS (SELECT image_id, {light_part('cx', '8')} AS cx, {light_part('cy', '8')} AS cy, greatest({light_part('rx', '8')}, 1) AS rx,
    greatest({light_part('ry', '8')}, 1) AS ry, {light_part('sharpness')} AS sharp, {light_part('intensity')} AS strength FROM n WHERE n = 1)
  SELECT p.image_id, p.y, p.x, round(coalesce(exp(-(pow((x - cx) / rx, 2) + pow((y - cy) / ry, 2)) * sharp) * strength, 0), 8) AS light
  FROM px p LEFT JOIN l ON l.image_id = p.image_id""")
def light_mask(spark, sf):
    sources = degrade.lights(F.col("image_id"), F.col("h"), F.col("w"))
    px = pixels.rgb_pixels(images(spark, sf).withColumn("lights", sources), keep=["lights"])
    level = degrade.light_level(F.col("y"), F.col("x"), F.col("lights"))
    return px.select("image_id", "y", "x", F.round(level, 8).alias("light"))


def many_lights(part: str, scale: str = "1") -> str:
    return between("image_id", f"'light/' || i || '/{part}'", *degrade.LIGHT[part]) + f" * {scale}"


@query("q_light_sources", f"""WITH s AS (SELECT doc_id AS image_id, 200 + n_chars % 500 AS h, 200 + doc_id % 600 AS w FROM documents),
  m AS (SELECT *, least(1, h * w / 262144.0::DOUBLE) AS share FROM s),
  n AS (SELECT *, floor({u('image_id', repr('lights'))} * (CASE WHEN share < 0.35 THEN 1 WHEN share < 0.75 THEN 2 ELSE 4 END + 1))::INT AS n FROM m),
  l AS (SELECT image_id, h, w, i, {many_lights('cx', 'w')} AS cx, {many_lights('cy', 'h')} AS cy, greatest({many_lights('rx', 'w')}, 1) AS rx,
    greatest({many_lights('ry', 'h')}, 1) AS ry, {many_lights('sharpness')} AS sharp, {many_lights('intensity')} AS strength
    FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM n)),
  g AS (SELECT image_id, count(*) AS n, sum(cx + cy + rx + ry) AS places, max(exp(-(pow((w / 2.0::DOUBLE - cx) / rx, 2) + pow((h / 2.0::DOUBLE - cy) / ry, 2)) * sharp) * strength) AS middle
    FROM l GROUP BY image_id)
  SELECT n.image_id, n.n AS n_lights, round(coalesce(places, 0), 6) AS places, round(coalesce(middle, 0), 8) AS middle FROM n LEFT JOIN g USING (image_id)""")
def light_sources(spark, sf):
    """Images of many sizes with none to four lights, and the level of light in their middle."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("image_id"), (F.col("n_chars") % 500 + 200).alias("h"), (F.col("doc_id") % 600 + 200).alias("w")
    )
    lit = docs.withColumn("lights", degrade.lights(F.col("image_id"), F.col("h"), F.col("w")))
    places = F.aggregate("lights", F.lit(0.0), lambda acc, light: acc + light["cx"] + light["cy"] + light["rx"] + light["ry"])
    middle = degrade.light_level(F.col("h") / 2.0, F.col("w") / 2.0, F.col("lights"))
    return lit.select("image_id", F.size("lights").alias("n_lights"), F.round(places, 6).alias("places"), F.round(middle, 8).alias("middle"))


def noise_sql(c: str) -> str:
    place = f"'{c}/' || y || '/' || x"
    return f"""floor(greatest(0, least(255, n_{c} / 0.02::DOUBLE + {gauss('image_id', "'read/' || " + place)} * 5 *
      {between('image_id', repr('sigma/' + c), 0.8, 1.2)})))::INT AS {c}"""


def shots_sql(c: str) -> str:
    """Poisson counts: distribution steps below the draw."""
    return f"""s_{c} AS (SELECT image_id, y, x, count(*) FILTER (cdf <= target) AS n FROM (
      SELECT image_id, y, x, {u('image_id', f"'shot/{c}/' || y || '/' || x")} AS target,
        sum(exp(-{c} * 0.02::DOUBLE) * CASE WHEN n = 0 THEN 1 ELSE pow({c} * 0.02::DOUBLE, n) / factorial(n::INT)::DOUBLE END)
          OVER (PARTITION BY image_id, y, x ORDER BY n) AS cdf
      FROM px8, range(33) t(n)) GROUP BY 1, 2, 3)"""


@query("q_noise", f"""WITH {PX}, {shots_sql('r')}, {shots_sql('g')}, {shots_sql('b')}, j AS (SELECT p.image_id, p.y, p.x, s_r.n AS n_r, s_g.n AS n_g, s_b.n AS n_b
    FROM px8 p JOIN s_r USING (image_id, y, x) JOIN s_g USING (image_id, y, x) JOIN s_b USING (image_id, y, x))
  SELECT image_id, y, x, {noise_sql('r')}, {noise_sql('g')}, {noise_sql('b')} FROM j""")
def noise(spark, sf):
    values = {
        c: degrade.noisy(F.col(c), F.col("image_id"), c, F.col("y"), F.col("x"), F.lit(0.02), F.lit(5.0)) for c in RGB
    }
    return rgb8(spark, sf).select("image_id", "y", "x", *[value.alias(c) for c, value in values.items()])


def eight_bit_rows(spark, sf):
    return image_rows(spark, sf).withColumn(
        "data", F.transform("data", lambda e: F.floor((e.cast("double") + 1.0) / 2.0 * 255.0).cast("int"))
    )


def back8(offset: int) -> str:
    return f"round_even({back(offset, '(h * 2.0)', '(s / 255)', '(v / 255)')} * 255, 0)"


def shot_sql(c: str) -> str:
    """Noise of one dark channel: Poisson counts are the steps of the distribution below the draw."""
    return f"""n_{c} AS (SELECT image_id, y, x, count(*) FILTER (cdf <= target) AS n FROM (
      SELECT image_id, y, x, {u('image_id', f"'shot/{c}/' || y || '/' || x")} AS target,
        sum(exp(-{c} * noise_k) * CASE WHEN n = 0 THEN 1 ELSE pow({c} * noise_k, n) / factorial(n::INT)::DOUBLE END)
          OVER (PARTITION BY image_id, y, x ORDER BY n) AS cdf FROM moved, range(33) t(n)) GROUP BY 1, 2, 3)"""


def noisy_sql(c: str) -> str:
    return f"""floor(greatest(0, least(255, n_{c}.n / noise_k + {gauss('m.image_id', f"'read/{c}/' || m.y || '/' || m.x")} * (noise_sigma_read *
      {between('m.image_id', repr('sigma/' + c), 0.8, 1.2)}))))::INT AS {c}"""


MIRRORED = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"
DRAWS = ", ".join(f"{between('vec_id', repr(name), *degrade.RANGES[name])} AS {name}" for name in DRAWN)
DEGRADED = f"""par AS (SELECT vec_id AS image_id, {DRAWS}, ({u('vec_id', "'vignette'")} < 0.5) AS use_vignette,
    ({u('vec_id', "'motion_blur'")} < 0.2) AS moving, (3 + 2 * floor({u('vec_id', "'motion_blur_kernel'")} * 4))::INT AS size,
    radians({between('vec_id', "'motion_blur_angle'", 0, 180)}) AS turn, floor({u('vec_id', repr('lights'))} * 2)::INT AS n_lights FROM embeddings),
  light AS (SELECT image_id, {light_part('cx', '8')} AS cx, {light_part('cy', '8')} AS cy, greatest({light_part('rx', '8')}, 1) AS rx,
    greatest({light_part('ry', '8')}, 1) AS ry, {light_part('sharpness')} AS sharp, {light_part('intensity')} AS strength FROM par WHERE n_lights = 1),
  lit AS (SELECT p.*, greatest(0, least(1, coalesce(exp(-(pow((x - cx) / rx, 2) + pow((y - cy) / ry, 2)) * sharp) * strength, 0))) AS m
    FROM px8 p LEFT JOIN light l ON l.image_id = p.image_id),
  hs AS (SELECT image_id, y, x, m, {HSV8.format('lit')}),
  d1 AS (SELECT hs.* EXCLUDE (s), gamma, noise_k, noise_sigma_read, use_vignette, vignette_strength, color_shift_factor,
    floor(greatest(0, least(255, s * saturation_factor))) AS s,
    pow(v / 255.0::DOUBLE, gamma) * linear_attenuation * (1 - m * headlight_boost) + v / 255.0::DOUBLE * (m * headlight_boost) AS vf FROM hs JOIN par USING (image_id)),
  d2 AS (SELECT * EXCLUDE (v), floor(greatest(0, least(255, vf * 255))) AS v, color_shift_factor * (1 - m) * greatest(0, least(1, 1 - vf)) * 255 AS shift,
    CASE WHEN use_vignette THEN greatest(0, least(1, 1 - vignette_strength * (((x - 4) * (x - 4) + (y - 4) * (y - 4)) / 32.0::DOUBLE))) ELSE 1 END AS k FROM d1),
  d3 AS (SELECT image_id, y, x, noise_k, noise_sigma_read, k, floor(greatest(0, least(255, {back8(5)} - shift * 0.5))) AS dr,
    {back8(3)} AS dg, floor(greatest(0, least(255, {back8(1)} + shift))) AS db FROM d2),
  d4 AS (SELECT image_id, y, x, noise_k, noise_sigma_read, floor(dr * k)::INT AS dr, floor(dg * k)::INT AS dg, floor(db * k)::INT AS db FROM d3),
  raw_taps AS (SELECT image_id, dy, dx, greatest(0, 1 - abs(dx * sin(turn) + dy * cos(turn))) *
      greatest(0, least(1, least(dx * cos(turn) - dy * sin(turn) + size // 2 + 1, size - (dx * cos(turn) - dy * sin(turn) + size // 2)))) / size AS k
    FROM par, (SELECT unnest(range(-4, 5)) AS dy), (SELECT unnest(range(-4, 5)) AS dx) WHERE moving AND abs(dy) <= size // 2 AND abs(dx) <= size // 2),
  taps AS (SELECT image_id, dy, dx, k / (sum(k) OVER (PARTITION BY image_id) + 1e-8) AS k FROM raw_taps),
  places AS (SELECT d4.image_id, d4.y, d4.x, {MIRRORED.format('d4.y + t.dy')} AS sy, {MIRRORED.format('d4.x + t.dx')} AS sx, t.k
    FROM d4 JOIN taps t ON t.image_id = d4.image_id),
  blurred AS (SELECT o.image_id, o.y, o.x, round_even(sum(q.dr * o.k), 0) AS dr, round_even(sum(q.dg * o.k), 0) AS dg, round_even(sum(q.db * o.k), 0) AS db
    FROM places o JOIN d4 q ON q.image_id = o.image_id AND q.y = o.sy AND q.x = o.sx GROUP BY 1, 2, 3),
  moved AS (SELECT d4.image_id, d4.y, d4.x, noise_k, noise_sigma_read, coalesce(b.dr, d4.dr) AS dr, coalesce(b.dg, d4.dg) AS dg, coalesce(b.db, d4.db) AS db
    FROM d4 LEFT JOIN blurred b ON b.image_id = d4.image_id AND b.y = d4.y AND b.x = d4.x),
  {', '.join(shot_sql(c) for c in DARK)},
  noisy AS (SELECT m.image_id, m.y, m.x, {', '.join(noisy_sql(c) for c in DARK)} FROM moved m
    {' '.join(f'JOIN n_{c} ON n_{c}.image_id = m.image_id AND n_{c}.y = m.y AND n_{c}.x = m.x' for c in DARK)}),
  sc AS (SELECT p.image_id, p.y, p.x, p.r, p.g, p.b, n.dr, n.dg, n.db FROM px8 p JOIN noisy n ON n.image_id = p.image_id AND n.y = p.y AND n.x = p.x),
  rt AS (SELECT image_id, avg(0.299::DOUBLE * dr + 0.587::DOUBLE * dg + 0.114::DOUBLE * db) / greatest(avg(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b), 1.0::DOUBLE) AS ratio
    FROM sc GROUP BY image_id)"""


@query("q_degrade", f"WITH {PX}, {DEGRADED} SELECT image_id, y, x, {guard_sql('r', 'dr')}, {guard_sql('g', 'dg')}, {guard_sql('b', 'db')} FROM sc JOIN rt USING (image_id)")
def degraded(spark, sf):
    """The whole degradation with drawn parameters."""
    params = degrade.draw_params(F.col("image_id"))
    return degrade.degrade(eight_bit_rows(spark, sf), params).select("image_id", "y", "x", *DARK)


@query("q_degrade_outcome", """SELECT vec_id AS image_id, (vec_id % 17 <> 3 AND vec_id % 19 <> 5)::INT AS ok,
    CASE WHEN vec_id % 19 = 5 THEN 'no data' WHEN vec_id % 17 = 3 THEN 'expected 192 values, found 100' END AS error,
    CASE WHEN vec_id % 17 <> 3 AND vec_id % 19 <> 5 THEN 64 ELSE 0 END AS n_pixels FROM embeddings""")
def degrade_outcome(spark, sf):
    """Some images are cut short, some have no data: the others are degraded, and these are told apart."""
    cut = F.when(F.col("image_id") % 17 == 3, F.slice("data", 1, 100)).otherwise(F.col("data"))
    broken = eight_bit_rows(spark, sf).withColumn("data", F.when(F.col("image_id") % 19 != 5, cut))
    done, outcome = degrade.degrade_batch(broken, degrade.draw_params(F.col("image_id")))
    counted = done.groupBy("image_id").agg(F.count("dr").alias("n"))
    return outcome.join(counted, "image_id", "left").select(
        "image_id", F.col("ok").cast("int").alias("ok"), "error", F.coalesce("n", F.lit(0)).cast("int").alias("n_pixels")
    )


# ---------------------------------------------------------------------------
# Night synthesis
# ---------------------------------------------------------------------------

MASKS = "mk AS (SELECT *, " + ", ".join(
    f"(label_id IN ({', '.join(map(str, ids))}))::INT::DOUBLE AS m_{name}" for name, ids in CLASS_GROUPS[LABEL_IDS].items()
) + " FROM src)"
WRAP = "(CASE WHEN (({0}) % 14 + 14) % 14 < 8 THEN (({0}) % 14 + 14) % 14 ELSE 14 - (({0}) % 14 + 14) % 14 END)"


def blur_sql(name: str, source: str, expr: str, ksize: int, sigma: float) -> str:
    """Blur of an expression over 8x8 images."""
    r = ksize // 2
    return f"""g_{name} AS (SELECT j - {r} AS d, exp(-pow(j - {r}, 2) / (2 * pow({sigma}::DOUBLE, 2))) / (SELECT sum(exp(-pow(t - {r}, 2) / (2 * pow({sigma}::DOUBLE, 2))))
    FROM range({ksize}) q(t)) AS k FROM range({ksize}) q(j)),
  w_{name} AS (SELECT o, {WRAP.format('o + d')} AS s, sum(k) AS k FROM range(8) q(o), g_{name} GROUP BY 1, 2),
  a_{name} AS (SELECT image_id, y, o AS x, sum(({expr}) * k) AS v FROM {source} JOIN w_{name} ON s = x GROUP BY 1, 2, 3),
  b_{name} AS (SELECT image_id, o AS y, x, sum(v * k) AS {name} FROM a_{name} JOIN w_{name} ON s = y GROUP BY 1, 2, 3)"""


def masked(spark, sf):
    return night.class_masks(night_source(spark, sf))


def maps(spark, sf):
    return night.blurred_maps(masked(spark, sf), list(RGB))


@query("q_sky_gradient", f"""WITH {PX} SELECT image_id, y, x, """ + ", ".join(
    f"round(greatest(0, least(1, {t}::DOUBLE * (1 - yy) + {b}::DOUBLE * yy + 0.006::DOUBLE * {gauss('image_id', f'''{repr('sky' + str(i) + '/')} || y || '/' || x''')})), 8) AS sky_{c}"
    for i, (c, t, b) in enumerate(zip("rgb", night.SKY_TOP, night.SKY_BOTTOM))
) + " FROM src")
def sky_gradient(spark, sf):
    sky = night_source(spark, sf).withColumns({f"sky_{c}": night.noisy_sky(i) for i, c in enumerate(RGB)})
    return sky.select("image_id", "y", "x", *[F.round(f"sky_{c}", 8).alias(f"sky_{c}") for c in RGB])


def noisy_sky_sql(i: int) -> str:
    """One channel of the gradient sky with its noise."""
    label = f"'sky{i}/' || y || '/' || x"
    base = f"{night.SKY_TOP[i]}::DOUBLE * (1 - yy) + {night.SKY_BOTTOM[i]}::DOUBLE * yy"
    return f"greatest(0, least(1, {base} + 0.006::DOUBLE * {gauss('image_id', label)}))"


STAR_LABEL = "'star/' || y || '/' || x"
STARS = blur_sql("stars", "src", f"({u('image_id', STAR_LABEL)} < 0.0009::DOUBLE)::INT::DOUBLE", 5, 1.3)


def starry_sql(i: int) -> str:
    return f"greatest(0, least(1, {noisy_sky_sql(i)} + stars * {night.STAR_COLOUR[i]}::DOUBLE))"


@query("q_sky_stars", f"WITH {PX}, {STARS} SELECT image_id, y, x, "
    + ", ".join(f"round({starry_sql(i)}, 8) AS sky_{c}" for i, c in enumerate("rgb")) + " FROM src JOIN b_stars USING (image_id, y, x)")
def sky_stars(spark, sf):
    """The rendered sky with its noise and stars."""
    sky = night.render_gradient_sky(night_source(spark, sf), True)
    return sky.select("image_id", "y", "x", *[F.round(f"sky_{c}", 8).alias(f"sky_{c}") for c in RGB])


N_ASSETS = 3


def asset_pixels(spark, sf):
    """The first images, on [0, 1], as sky assets; the last of the assets has no pixels."""
    rows = image_rows(spark, sf).where(F.col("image_id") < N_ASSETS - 1)
    px = pixels.rgb_pixels(rows).withColumns({c: (F.col(c) + 1.0) / 2.0 for c in RGB})
    return px.withColumnRenamed("image_id", "asset_id").withColumn("asset_id", F.col("asset_id").cast("int"))


@query("q_asset_fit", f"""WITH {PX}, {gray_plans.axis_sql('wt', '[5, 12]')},
  pick AS (SELECT vec_id AS image_id, floor({u('vec_id', repr('asset'))} * {N_ASSETS})::INT AS asset_id, CASE WHEN vec_id % 2 = 0 THEN 5 ELSE 12 END AS n FROM embeddings),
  across AS (SELECT p.image_id AS asset_id, p.y, wt.n, wt.o AS x, sum(r * k) AS r, sum(g * k) AS g, sum(b * k) AS b FROM px p JOIN wt ON wt.s = p.x
    WHERE p.image_id < {N_ASSETS - 1} GROUP BY 1, 2, 3, 4),
  fit AS (SELECT asset_id, a.n, wt.o AS y, x, sum(r * k) AS r, sum(g * k) AS g, sum(b * k) AS b FROM across a JOIN wt ON wt.n = a.n AND wt.s = a.y GROUP BY 1, 2, 3, 4)
  SELECT image_id, pick.n AS side, count(fit.r) AS n_pixels, round(sum(fit.r * (fit.y + 1) * (fit.x + 2)), 5) AS moment, round(sum(fit.g + fit.b), 5) AS total
  FROM pick LEFT JOIN fit ON fit.asset_id = pick.asset_id AND fit.n = pick.n GROUP BY 1, 2""")
def asset_fit(spark, sf):
    """A sky asset per image, fitted to the image's shape; images whose asset has no pixels stay."""
    side = F.when(F.col("image_id") % 2 == 0, 5).otherwise(12)
    rows = image_rows(spark, sf).select("image_id", side.alias("h"), side.alias("w"))
    fitted = night.with_assets(rows, asset_pixels(spark, sf), N_ASSETS)
    sky = fitted.select("image_id", F.col("w").alias("side"), F.posexplode_outer("sky").alias("p", "v"))
    place, channel = F.floor(F.col("p") / 3), F.col("p") % 3
    weight = (F.floor(place / F.col("side")) + 1) * (place % F.col("side") + 2)
    return sky.groupBy("image_id", "side").agg(
        F.count_if(F.col("v").isNotNull() & (channel == 0)).alias("n_pixels"),
        F.round(F.sum(F.when(channel == 0, F.col("v") * weight)), 5).alias("moment"),
        F.round(F.sum(F.when(channel > 0, F.col("v"))), 5).alias("total"),
    )


def paired_sky(spark, sf):
    """The next image stands for the sky asset of an image; the two are joined as image rows."""
    rows = image_rows(spark, sf)
    other = rows.select((F.col("image_id") - 1).alias("image_id"), F.col("data").alias("sky"))
    both = pixels.by_image(rows).join(pixels.by_image(other), "image_id")
    px = labelled(pixels.rgb_pixels(both, also={"sky_": "sky"}))
    values = [*RGB, *[f"sky_{c}" for c in RGB]]
    return night.class_masks(px.withColumns({c: colour.to_uint8((F.col(c) + 1.0) / 2.0 * 255.0) / 255.0 for c in values}))


@query("q_sky_match", f"""WITH {PX}, {MASKS}, p AS (SELECT k.*, s.r AS sky_r, s.g AS sky_g, s.b AS sky_b FROM mk k
    JOIN src s ON s.image_id = k.image_id + 1 AND s.y = k.y AND s.x = k.x),
  m AS (SELECT image_id, {', '.join(f"avg({c}) FILTER (m_sky > 0.05) AS s{c}, avg(sky_{c}) FILTER (m_sky > 0.05) AS a{c}" for c in 'rgb')} FROM p GROUP BY image_id)
  SELECT image_id, y, x, """ + ", ".join(
    f"round(CASE WHEN s{c} IS NULL THEN sky_{c} ELSE greatest(0, least(1, sky_{c} * greatest(0.2, least(0.55, greatest(s{c}, 0.03::DOUBLE) / greatest(a{c}, 1e-4::DOUBLE))) * {t}::DOUBLE)) END, 8) AS sky_{c}"
    for c, t in zip("rgb", night.ASSET_TINT)
) + " FROM p JOIN m USING (image_id)")
def sky_match(spark, sf):
    sky = night.match_sky(paired_sky(spark, sf))
    return sky.select("image_id", "y", "x", *[F.round(f"sky_{c}", 8).alias(f"sky_{c}") for c in RGB])


def fold_setting(index: int) -> str:
    value = f"{night.BASE_SETTING[index]}::DOUBLE"
    for group, *targets in night.CLASS_SETTINGS:
        value = f"({value} * (1 - soft_{group}) + {targets[index]}::DOUBLE * soft_{group})"
    return value


SOFT = ", ".join(blur_sql(f"soft_{g}", "mk", f"m_{g}", 3, 0.08) for g in night.GROUPS)
SOFT_JOIN = " ".join(f"JOIN b_soft_{g} USING (image_id, y, x)" for g in night.GROUPS)


@query("q_class_darken", f"""WITH {PX}, {MASKS}, {SOFT}, all_maps AS (SELECT * FROM mk {SOFT_JOIN}),
  st AS (SELECT *, {fold_setting(0)} AS gm, {fold_setting(1)} AS am, {fold_setting(2)} AS sm FROM all_maps),
  hv AS (SELECT image_id, y, x, gm, am, sm, {HSV.format('st')}),
  dk AS (SELECT image_id, y, x, h, greatest(0, least(1, s * sm)) AS s, greatest(0, least(1, pow(v, gm) * am)) AS v FROM hv)
  SELECT image_id, y, x, round({back(5)}, 6) AS r, round({back(3)}, 6) AS g, round({back(1)}, 6) AS b FROM dk""")
def class_darken(spark, sf):
    dark = night.darken(maps(spark, sf))
    return dark.select("image_id", "y", "x", *[F.round(c, 6).alias(c) for c in RGB])


def mix_sql(weights) -> str:
    total = " + ".join(f"{w}::DOUBLE * m_{g}" for g, w in weights.items())
    return f"greatest(0, least(1, {total}))"


NEAR = "(0.1::DOUBLE + 0.9::DOUBLE * pow(yy, 1.6::DOUBLE))"
ILLUM = ", ".join([
    blur_sql("pool", "mk", mix_sql(night.FOCUS), 13, 3.0),
    blur_sql("ambient", "mk", "m_sky", 3, 0.4),
    blur_sql("road_glow", "mk", f"m_road * {NEAR}", 3, 0.096),
])


@query("q_illumination", f"""WITH {PX}, {MASKS}, {ILLUM}, j AS (SELECT * FROM mk JOIN b_pool USING (image_id, y, x) JOIN b_ambient USING (image_id, y, x) JOIN b_road_glow USING (image_id, y, x)),
  p AS (SELECT *, greatest(0, least(1, pool * (0.2::DOUBLE + 0.8::DOUBLE * pow(yy, 1.8::DOUBLE)) * {between('image_id', repr('pool'), 0.7, 1.0)})) AS warm FROM j),
  q AS (SELECT *, warm * {mix_sql(night.INFLUENCE)} * {NEAR} AS spread, road_glow * greatest(0, least(1, warm * 1.2::DOUBLE + 0.25 * m_vehicle)) AS road FROM p)
  SELECT image_id, y, x, """ + ", ".join(
    f"round(greatest(0, least(0.16, spread * {a}::DOUBLE + road * {b}::DOUBLE{' + ambient * 0.015::DOUBLE * (1 - 0.55::DOUBLE * yy)' if c == 'b' else ''})), 8) AS light_{c}"
    for c, a, b in zip("rgb", night.POOL_COLOUR, night.ROAD_COLOUR)
) + " FROM q")
def illumination(spark, sf):
    light = night.illumination(night.pool_strength(True))
    return maps(spark, sf).select("image_id", "y", "x", *[F.round(v, 8).alias(f"light_{c}") for c, v in light.items()])


@query("q_emissive", f"""WITH {PX}, {MASKS}, {blur_sql('emissive', 'mk', mix_sql(night.EMISSIVE), 3, 0.064)}
  SELECT image_id, y, x, """ + ", ".join(
    f"round({c} * 0.3::DOUBLE * (1 - emissive * 0.22::DOUBLE) + {c} * emissive * 0.22::DOUBLE, 8) AS {c}" for c in "rgb"
) + " FROM mk JOIN b_emissive USING (image_id, y, x)")
def emissive(spark, sf):
    """The source dimmed to 30 percent is blended toward the source where something shines."""
    values = {c: night.emissive(F.col(c) * 0.3, F.col(c)) for c in RGB}
    return maps(spark, sf).select("image_id", "y", "x", *[F.round(v, 8).alias(c) for c, v in values.items()])


def clip_sql(value: str) -> str:
    return f"greatest(0, least(1, {value}))"


def night_light(i: int, c: str) -> str:
    """Added light of one channel."""
    glow = f"spread * {night.POOL_COLOUR[i]}::DOUBLE + road * {night.ROAD_COLOUR[i]}::DOUBLE"
    return f"greatest(0, least(0.16, {glow}{' + ambient * 0.015::DOUBLE * (1 - 0.55::DOUBLE * yy)' if c == 'b' else ''}))"


def night_guard(c: str) -> str:
    alpha = clip_sql("(0.08::DOUBLE - ratio) / 0.08::DOUBLE")
    return clip_sql(
        f"CASE WHEN ratio < 0.08::DOUBLE THEN d{c} * (1 - {alpha}) + s{c} * {alpha} * 0.35::DOUBLE"
        f" WHEN ratio > 0.6::DOUBLE THEN d{c} * (0.6::DOUBLE / greatest(ratio, 1e-6::DOUBLE)) ELSE d{c} END"
    )


EVERY_MAP = " ".join(f"JOIN b_{name} USING (image_id, y, x)" for name in ("pool", "ambient", "road_glow", "emissive", "stars"))
LUMA_SQL = "avg(0.299::DOUBLE * {0}r + 0.587::DOUBLE * {0}g + 0.114::DOUBLE * {0}b)"
NIGHT = f"""{PX}, {MASKS}, {SOFT}, {ILLUM}, {blur_sql('emissive', 'mk', mix_sql(night.EMISSIVE), 3, 0.064)}, {STARS},
  fg AS (SELECT image_id, y, x, y * 8 + x AS p FROM mk WHERE m_sky > 0.5),
  near AS (SELECT a.image_id, a.p, b.p AS q FROM fg a JOIN fg b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
  reach AS (SELECT image_id, p, p AS q FROM fg UNION SELECT r.image_id, r.p, n.q FROM reach r JOIN near n ON n.image_id = r.image_id AND n.p = r.q),
  sizes AS (SELECT image_id, component, count(*) AS size FROM (SELECT image_id, p, min(q) AS component FROM reach GROUP BY 1, 2) GROUP BY 1, 2),
  cover AS (SELECT image_id, avg(m_sky) AS coverage FROM mk GROUP BY image_id),
  used AS (SELECT image_id, coverage BETWEEN 0.02 AND 0.7 AND coalesce(share, 0) > 0.1 AS usable FROM cover
    LEFT JOIN (SELECT image_id, max(size) / sum(size) AS share FROM sizes GROUP BY image_id) USING (image_id)),
  whole AS (SELECT *, CASE WHEN usable THEN soft_sky ELSE 0 END AS a FROM mk {SOFT_JOIN} {EVERY_MAP} JOIN used USING (image_id)),
  wk AS (SELECT * EXCLUDE (r, g, b), r AS sr, g AS sg, b AS sb, {', '.join(f"{clip_sql(f'{c} * (1 - a) + {starry_sql(i)} * a')} AS {c}" for i, c in enumerate('rgb'))} FROM whole),
  st AS (SELECT *, {fold_setting(0)} AS gm, {fold_setting(1)} AS am, {fold_setting(2)} AS sm FROM wk),
  hv AS (SELECT *, {HSV.format('st')}),
  dk AS (SELECT * EXCLUDE (s, v), {clip_sql('s * sm')} AS s, {clip_sql(f'pow({clip_sql("v")}, gm) * am')} AS v FROM hv),
  warmed AS (SELECT *, {clip_sql(f"pool * (0.2::DOUBLE + 0.8::DOUBLE * pow(yy, 1.8::DOUBLE)) * {between('image_id', repr('pool'), 0.7, 1.0)}")} AS warm FROM dk),
  spreads AS (SELECT *, warm * {mix_sql(night.INFLUENCE)} * {NEAR} AS spread, road_glow * {clip_sql('warm * 1.2::DOUBLE + 0.25 * m_vehicle')} AS road FROM warmed),
  lit AS (SELECT image_id, y, x, sr, sg, sb, emissive, {', '.join(f"{clip_sql(f'{clip_sql(back(o))} + {night_light(i, c)}')} AS n{c}" for i, (c, o) in enumerate(zip('rgb', (5, 3, 1))))} FROM spreads),
  shone AS (SELECT image_id, y, x, sr, sg, sb, {', '.join(f"{clip_sql(f'n{c} * (1 - emissive * 0.22::DOUBLE) + greatest(n{c}, s{c}) * (emissive * 0.22::DOUBLE)')} AS d{c}" for c in 'rgb')} FROM lit),
  rt AS (SELECT image_id, {LUMA_SQL.format('d')} / greatest({LUMA_SQL.format('s')}, 1e-6::DOUBLE) AS ratio FROM shone GROUP BY image_id)"""


@query("q_night", f"WITH RECURSIVE {NIGHT} SELECT image_id, y, x, " + ", ".join(f"round({night_guard(c)}, 6) AS d{c}" for c in "rgb") + " FROM shone JOIN rt USING (image_id)")
def night_images(spark, sf):
    """The whole synthesis on labelled images."""
    result = night.synthesize(night_source(spark, sf), image_rows(spark, sf))
    return result.select("image_id", "y", "x", *[F.round(c, 6).alias(c) for c in DARK])


FOREGROUND = gray_plans.PX + """, fg AS (SELECT image_id, y, x, y * 8 + x AS p FROM px WHERE v > 0.525),
near AS (SELECT a.image_id, a.p, b.p AS q FROM fg a JOIN fg b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
reach AS (SELECT image_id, p, p AS q FROM fg UNION SELECT r.image_id, r.p, n.q FROM reach r JOIN near n ON n.image_id = r.image_id AND n.p = r.q),
part AS (SELECT image_id, p, min(q) AS component FROM reach GROUP BY 1, 2),
sizes AS (SELECT image_id, component, count(*) AS size FROM part GROUP BY 1, 2)"""


@query("q_components", f"WITH RECURSIVE {FOREGROUND} SELECT image_id, count(*) AS n_components, max(size) AS largest, sum(size)::BIGINT AS total FROM sizes GROUP BY image_id")
def connected(spark, sf):
    """Tiles of 4x4, so the 8x8 images are put together from four tiles."""
    foreground = gray_plans.gray(spark, sf).where(F.col("v") > 0.525)
    parts = components.components(foreground, tile=4)
    return parts.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"), F.sum("size").alias("total")
    )


@query("q_sky_usable", f"""WITH RECURSIVE {FOREGROUND}, c AS (SELECT image_id, avg((v > 0.525)::INT) AS coverage FROM px GROUP BY image_id),
  s AS (SELECT image_id, max(size) / sum(size) AS share FROM sizes GROUP BY image_id)
  SELECT image_id, round(coverage, 6) AS coverage, round(coalesce(share, 0), 6) AS largest_share,
    (coverage BETWEEN 0.02 AND 0.7 AND coalesce(share, 0) > 0.1)::INT AS usable FROM c LEFT JOIN s USING (image_id)""")
def sky_usable(spark, sf):
    sky = (F.col("v") > 0.525).cast("double").alias(night.mask_name("sky"))
    px = gray_plans.gray(spark, sf).select("image_id", "y", "x", sky)
    found = night.sky_usable(px)
    return found.withColumns({n: F.round(n, 6) for n in ("coverage", "largest_share")})
