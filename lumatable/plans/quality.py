"""Quality and transform queries. An embedding (64 values) stands for an 8x8 grey image; image k is paired with image k+1."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable.functions import colour, tables
from lumatable.operators import pixels, quality
from lumatable.plans.registry import query, table

BATCH = 16


def image_rows(spark, sf):
    """Values on [-1, 1]."""
    side = F.sqrt(F.size("embedding")).cast("int")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), side.alias("h"), side.alias("w"), F.col("embedding").alias("data"), "label"
    )


def images(spark, sf):
    return pixels.by_image(image_rows(spark, sf))


def gray(spark, sf):
    """Pixels on [0, 1]."""
    return pixels.gray_pixels(images(spark, sf)).withColumn("v", (F.col("v") + 1.0) / 2.0)


def image_pairs(spark, sf):
    """Image k next to image k+1: joined once per image, before any pixel is unpacked."""
    left = images(spark, sf).withColumnRenamed("data", "a")
    right = table(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("image_id"), F.col("embedding").alias("b"))
    right = pixels.by_image(right)
    return left.join(right, "image_id")


def model_pairs(spark, sf):
    return pixels.pair_pixels(image_pairs(spark, sf))


def unit_image_pairs(spark, sf):
    """Pairs as image rows with arrays on [0, 1]."""
    unit = {name: F.transform(name, lambda e: (e.cast("double") + 1.0) / 2.0) for name in ("a", "b")}
    return image_pairs(spark, sf).withColumns(unit)


def pairs(spark, sf):
    return model_pairs(spark, sf).withColumns({name: (F.col(name) + 1.0) / 2.0 for name in ("a", "b")})


PX = """px AS (SELECT vec_id AS image_id, i // 8 AS y, i % 8 AS x, e AS m, (e + 1) / 2 AS v FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""
PAIRS = PX + """, pp AS (SELECT p.image_id, p.y, p.x, p.v AS a, q.v AS b, p.m AS ma, q.m AS mb FROM px p
  JOIN px q ON q.image_id = p.image_id + 1 AND q.y = p.y AND q.x = p.x)"""
GAUSS11 = """g AS (SELECT j - 5 AS d, exp(-pow(j - 5, 2) / 4.5::DOUBLE) / (SELECT sum(exp(-pow(t - 5, 2) / 4.5::DOUBLE)) FROM range(11) r(t)) AS k FROM range(11) r(j))"""
SSIM = GAUSS11 + """,
sx AS (SELECT p.image_id, p.y, o.x, sum(a * k) AS a, sum(b * k) AS b, sum(a * a * k) AS aa, sum(b * b * k) AS bb, sum(a * b * k) AS ab
  FROM (SELECT unnest(range(8)) AS x) o, g, pp p WHERE p.x = o.x + g.d GROUP BY 1, 2, 3),
sy AS (SELECT s.image_id, o.y, s.x, sum(a * k) AS a, sum(b * k) AS b, sum(aa * k) AS aa, sum(bb * k) AS bb, sum(ab * k) AS ab
  FROM (SELECT unnest(range(8)) AS y) o, g, sx s WHERE s.y = o.y + g.d GROUP BY 1, 2, 3),
ssim AS (SELECT image_id, avg((2 * a * b + 0.0001::DOUBLE) * (2 * (ab - a * b) + 0.0009::DOUBLE)
  / ((a * a + b * b + 0.0001::DOUBLE) * (aa - a * a + bb - b * b + 0.0009::DOUBLE))) AS ssim FROM sy GROUP BY image_id)"""
WAVELET = """blocks AS (SELECT image_id, y // 2 AS cy, x // 2 AS cx,
    abs(sum((a - b) * (CASE WHEN y % 2 = 0 THEN 1 ELSE -1 END))) AS lh, abs(sum((a - b) * (CASE WHEN x % 2 = 0 THEN 1 ELSE -1 END))) AS hl,
    abs(sum((a - b) * (CASE WHEN (x + y) % 2 = 0 THEN 1 ELSE -1 END))) AS hh FROM pp GROUP BY 1, 2, 3),
wavelet AS (SELECT image_id, avg((lh + hl + hh) / 2) / 3 AS wavelet FROM blocks GROUP BY image_id)"""
FREQUENCY = """fx AS (SELECT image_id, y, o, sum(a * cos(2 * pi() * x * o / 8)) AS ar, -sum(a * sin(2 * pi() * x * o / 8)) AS ai,
    sum(b * cos(2 * pi() * x * o / 8)) AS br, -sum(b * sin(2 * pi() * x * o / 8)) AS bi FROM pp, range(5) r(o) GROUP BY 1, 2, 3),
fy AS (SELECT image_id, o, p, sum(ar * cos(t) + ai * sin(t)) AS ar, sum(ai * cos(t) - ar * sin(t)) AS ai,
    sum(br * cos(t) + bi * sin(t)) AS br, sum(bi * cos(t) - br * sin(t)) AS bi
  FROM (SELECT *, 2 * pi() * y * p / 8 AS t FROM fx, range(8) r(p)) GROUP BY 1, 2, 3),
frequency AS (SELECT image_id, avg(abs(ln(1 + sqrt(ar * ar + ai * ai) / 8) - ln(1 + sqrt(br * br + bi * bi) / 8))) AS frequency FROM fy GROUP BY image_id)"""
EDGE = """n9 AS (SELECT dy, dx, dx * (2 - abs(dy)) AS kx, dy * (2 - abs(dx)) AS ky FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
grad AS (SELECT p.image_id, p.y, p.x, sum(coalesce(q.a, 0) * kx) AS ax, sum(coalesce(q.a, 0) * ky) AS ay, sum(coalesce(q.b, 0) * kx) AS cx, sum(coalesce(q.b, 0) * ky) AS cy
  FROM (SELECT * FROM pp, n9) p LEFT JOIN pp q ON q.image_id = p.image_id AND q.y = p.y + p.dy AND q.x = p.x + p.dx GROUP BY 1, 2, 3),
edge AS (SELECT image_id, avg(abs(sqrt(ax * ax + ay * ay + 1e-6) - sqrt(cx * cx + cy * cy + 1e-6))) AS edge FROM grad GROUP BY image_id)"""


def rounded(df, *names, digits=6):
    return df.withColumns({name: F.round(name, digits) for name in names})


@query("q_psnr", f"""WITH {PAIRS}, m AS (SELECT image_id, avg((a - b) * (a - b)) AS mse FROM pp GROUP BY image_id)
  SELECT image_id, round(mse, 8) AS mse, round(10 * log10(1 / nullif(mse, 0)), 6) AS psnr FROM m""")
def psnr(spark, sf):
    return rounded(quality.psnr(pairs(spark, sf)), "psnr").withColumn("mse", F.round("mse", 8))


POOLED = f"""WITH {PAIRS}, e AS (SELECT image_id, sum((a - b) * (a - b)) AS sq, count(*) AS n FROM pp GROUP BY image_id),
  o AS (SELECT *, (row_number() OVER (ORDER BY image_id) - 1) AS i FROM e),
  batches AS (SELECT i // {BATCH} AS batch, 10 * log10(1 / (sum(sq) / sum(n))) AS psnr, count(*) AS images FROM o WHERE i < LIMIT_N GROUP BY 1)"""


@query("q_psnr_pooled", POOLED.replace("LIMIT_N", "1e18") + " SELECT batch, round(psnr, 6) AS psnr, images FROM batches")
def psnr_pooled(spark, sf):
    errors = quality.squared_error(pairs(spark, sf))
    return rounded(quality.pooled_psnr(errors, "image_id", BATCH), "psnr")


@query("q_validation_limit", POOLED.replace("LIMIT_N", "40") + " SELECT round(sum(psnr * images) / sum(images), 6) AS psnr, sum(images)::BIGINT AS images FROM batches")
def validation_limit(spark, sf):
    """A validation report over its first 40 images: the last batch is cut."""
    first = image_pairs(spark, sf).orderBy("image_id").limit(40)  # only these are unpacked and scored
    errors = quality.squared_error(pixels.pair_pixels(first).withColumns({n: (F.col(n) + 1.0) / 2.0 for n in ("a", "b")}))
    return rounded(quality.weighted_batches(quality.pooled_psnr(errors, "image_id", BATCH, 40)), "psnr")


@query("q_ssim", f"WITH {PAIRS}, {SSIM} SELECT image_id, round(ssim, 6) AS ssim FROM ssim")
def ssim(spark, sf):
    return rounded(quality.ssim(unit_image_pairs(spark, sf)), "ssim")


@query("q_evaluate", f"""WITH {PAIRS}, {SSIM}, {WAVELET}, m AS (SELECT image_id, 10 * log10(1 / nullif(avg((a - b) * (a - b)), 0)) AS psnr FROM pp GROUP BY image_id)
  SELECT label, round(avg(psnr), 6) AS psnr, round(avg(ssim), 6) AS ssim, round(avg(wavelet), 6) AS wavelet, count(*) AS images
  FROM m JOIN ssim USING (image_id) JOIN wavelet USING (image_id) JOIN embeddings ON vec_id = image_id GROUP BY label""")
def evaluate(spark, sf):
    """Chosen metrics per image, averaged per label."""
    names = ["psnr", "ssim", "wavelet"]
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), "label")
    scored = quality.score(unit_image_pairs(spark, sf), names).join(labels, "image_id")
    return scored.groupBy("label").agg(*[F.round(F.avg(n), 6).alias(n) for n in names], F.count(F.lit(1)).alias("images"))


@query("q_charbonnier", f"WITH {PAIRS} SELECT image_id, round(avg(sqrt((ma - mb) * (ma - mb) + 1e-6)), 8) AS charbonnier FROM pp GROUP BY image_id")
def charbonnier(spark, sf):
    return rounded(quality.charbonnier(model_pairs(spark, sf)), "charbonnier", digits=8)


@query("q_tv", f"""WITH {PX}, d AS (SELECT image_id, abs(lead(v) OVER (PARTITION BY image_id, x ORDER BY y) - v) AS dn,
  abs(lead(v) OVER (PARTITION BY image_id, y ORDER BY x) - v) AS rt FROM px) SELECT image_id, round(avg(dn) + avg(rt), 8) AS tv FROM d GROUP BY image_id""")
def tv(spark, sf):
    return rounded(quality.total_variation(gray(spark, sf), "v"), "tv", digits=8)


@query("q_edge", f"WITH {PAIRS}, {EDGE} SELECT image_id, round(edge, 6) AS edge FROM edge")
def edge(spark, sf):
    return rounded(quality.edge(unit_image_pairs(spark, sf)), "edge")


@query("q_wavelet", f"WITH {PAIRS}, {WAVELET} SELECT image_id, round(wavelet, 8) AS wavelet FROM wavelet")
def wavelet(spark, sf):
    return rounded(quality.wavelet(pairs(spark, sf)), "wavelet", digits=8)


@query("q_frequency", f"WITH {PAIRS}, {FREQUENCY} SELECT image_id, round(frequency, 6) AS frequency FROM frequency")
def frequency(spark, sf):
    return rounded(quality.frequency(pairs(spark, sf)), "frequency")


@query("q_retinex_terms", f"""WITH {PAIRS}, t AS (SELECT *, 1 - a / 2 AS r_low, 1 - b / 2 AS r_high FROM pp),
  m AS (SELECT image_id, avg(abs(r_low * a - a)) AS l_recon_low, avg(abs(r_high * b - b)) AS l_recon_high, avg(abs(r_low - r_high)) AS l_consistency,
    greatest(0, 0.05 - (avg(b) - avg(a))) AS l_exposure FROM t GROUP BY image_id),
  d AS (SELECT image_id, abs(lead(a) OVER c - a) AS ad, abs(lead(a) OVER r - a) AS ar, abs(lead(b) OVER c - b) AS bd, abs(lead(b) OVER r - b) AS br FROM t
    WINDOW c AS (PARTITION BY image_id, x ORDER BY y), r AS (PARTITION BY image_id, y ORDER BY x)),
  v AS (SELECT image_id, avg(ad) + avg(ar) + avg(bd) + avg(br) AS l_tv FROM d GROUP BY image_id)
  SELECT image_id, round(l_recon_low, 8) AS l_recon_low, round(l_recon_high, 8) AS l_recon_high, round(l_consistency, 8) AS l_consistency,
    round(l_exposure, 8) AS l_exposure, round(l_tv, 8) AS l_tv,
    round(l_recon_low + l_recon_high + l_consistency + 0.1 * l_tv + 0.1 * l_exposure, 8) AS retinex_total FROM m JOIN v USING (image_id)""")
def retinex_terms(spark, sf):
    # The image itself stands for its illumination, one minus half of it for its reflectance.
    def reflectance(side):
        return F.transform(side, lambda v: 1.0 - v / 2.0)

    parts = unit_image_pairs(spark, sf).withColumns(
        {
            "low": F.col("a"), "high": F.col("b"), "i_low": F.col("a"), "i_high": F.col("b"),
            "r_low": reflectance("a"), "r_high": reflectance("b"),
        }
    )
    terms = quality.retinex_terms(parts)
    return rounded(terms, *terms.columns[1:], digits=8)


WEIGHTS = {"wavelet": 0.05, "frequency": 0.02, "edge": 0.03}


@query("q_composite", f"""WITH {PAIRS}, {SSIM}, {WAVELET}, {FREQUENCY}, {EDGE},
  c AS (SELECT image_id, avg(sqrt((ma - mb) * (ma - mb) + 1e-6)) AS c FROM pp GROUP BY image_id),
  t AS (SELECT image_id, label + 1 AS w, c, 1 - ssim AS s, c + 0.1 * (1 - ssim) + 0.05 * wavelet + 0.02 * frequency + 0.03 * edge AS total
    FROM c JOIN ssim USING (image_id) JOIN wavelet USING (image_id) JOIN frequency USING (image_id) JOIN edge USING (image_id)
    JOIN embeddings ON vec_id = image_id)
  SELECT w AS weight, round(sum(c * w) / sum(w), 6) AS l_pix, round(sum(s * w) / sum(w), 6) AS l_ssim, round(sum(total * w) / greatest(sum(w), 1e-8), 6) AS l_total
  FROM t GROUP BY w""")
def composite(spark, sf):
    terms = quality.composite(image_pairs(spark, sf), WEIGHTS)
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("image_id"), (F.col("label") + 1).alias("weight"))
    means = {"l_pix": "char", "l_ssim": "ssim", "l_total": "total"}
    return terms.join(labels, "image_id").groupBy("weight").agg(
        *[F.round(quality.sample_mean(F.col(term), F.col("weight")), 6).alias(name) for name, term in means.items()]
    )


@query("q_feature_distance", """SELECT p.label, round(avg(sqrt(list_sum(list_transform(list_zip(p.embedding, q.embedding),
    lambda t: pow(t[1]::DOUBLE - t[2]::DOUBLE, 2))))), 6) AS semantic_distance, count(*) AS n_pairs
  FROM embeddings p JOIN embeddings q ON q.vec_id = p.vec_id + 1 GROUP BY p.label""")
def feature_distance(spark, sf):
    distance = quality.feature_distance("a", "b")
    return image_pairs(spark, sf).groupBy("label").agg(
        F.round(F.avg(distance), 6).alias("semantic_distance"), F.count(F.lit(1)).alias("n_pairs")
    )


@query("q_normalize", f"""WITH {PX}, s AS (SELECT image_id, y, x, CASE WHEN image_id % 2 = 0 THEN v ELSE v * 255 END AS v FROM px),
  t AS (SELECT image_id, max(v) AS top FROM s GROUP BY image_id)
  SELECT image_id, y, x, round(CASE WHEN top > 1.5 THEN v / 255 ELSE v END * 2 - 1, 8) AS m,
    round(greatest(0, least(1, (CASE WHEN top > 1.5 THEN v / 255 ELSE v END * 2 - 1) / 2 + 0.5)), 8) AS back FROM s JOIN t USING (image_id)""")
def normalize(spark, sf):
    # Every other image is on the 0-255 scale.
    scale = F.when(F.col("image_id") % 2 == 0, 1.0).otherwise(255.0)
    scaled = images(spark, sf).withColumn("data", F.transform("data", lambda e: (e.cast("double") + 1.0) / 2.0 * scale))
    model = pixels.model_space(scaled)
    return model.select(
        "image_id", "y", "x", F.round("v", 8).alias("m"), F.round(colour.from_model_space(F.col("v")), 8).alias("back")
    )


@query("q_residual", f"""WITH {PAIRS} SELECT image_id, y, x, round((mb - ma) * 0.5, 8) AS residual,
  round(greatest(-1, least(1, ma + (mb - ma) * 0.5 / 0.5)), 8) AS decoded FROM pp""")
def residual(spark, sf):
    target = colour.residual_target(F.col("b"), F.col("a"), 0.5)
    decoded = colour.residual_decoded(F.col("a"), target, 0.5)
    return model_pairs(spark, sf).select(
        "image_id", "y", "x", F.round(target, 8).alias("residual"), F.round(decoded, 8).alias("decoded")
    )


def axis_sql(name: str, size: str) -> str:
    """Bilinear weights of one axis from 8 to a target size per image."""
    return f"""{name} AS (SELECT n, o, least(i + d, 7) AS s, CASE d WHEN 0 THEN 1 - f ELSE f END AS k FROM (
      SELECT n, o, least(floor(p)::INT, 7) AS i, p - least(floor(p), 7) AS f FROM (
        SELECT n, o, greatest((o + 0.5::DOUBLE) * 8 / n - 0.5::DOUBLE, 0) AS p FROM (SELECT unnest({size}) AS n), range(12) r(o) WHERE o < n)),
      (SELECT unnest([0, 1]) AS d))"""


@query("q_resize", f"""WITH {PX}, {axis_sql('wt', '[5, 12, 8]')}, t AS (SELECT *, CASE image_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 12 ELSE 8 END AS n FROM px),
  across AS (SELECT t.image_id, t.n, t.y, wt.o AS x, sum(v * k) AS v FROM t JOIN wt ON wt.n = t.n AND wt.s = t.x GROUP BY 1, 2, 3, 4)
  SELECT image_id, wt.o AS y, x, round(sum(v * k), 6) AS v FROM across a JOIN wt ON wt.n = a.n AND wt.s = a.y GROUP BY 1, 2, 3""")
def resize(spark, sf):
    side = F.element_at(F.array(F.lit(5), F.lit(12), F.lit(8)), (F.col("image_id") % 3 + 1).cast("int"))
    resized = pixels.resize(gray(spark, sf), side, side, ["v"])
    return resized.select("image_id", "y", "x", F.round("v", 6).alias("v"))


@query("q_resize_weights", """WITH n AS (SELECT DISTINCT 1 + doc_id % 9 AS source, 1 + n_chars % 7 AS target FROM documents),
  p AS (SELECT source, target, o, greatest((o + 0.5::DOUBLE) * source / target - 0.5::DOUBLE, 0) AS place FROM n, range(7) r(o) WHERE o < target),
  f AS (SELECT source, target, o, least(floor(place), source - 1)::INT AS low, place - least(floor(place), source - 1) AS share FROM p)
  SELECT source, target, o::INT AS o, low AS s, round(CASE WHEN low = source - 1 THEN 1 ELSE 1 - share END, 9) AS k FROM f
  UNION ALL SELECT source, target, o::INT, low + 1, round(share, 9) FROM f WHERE low < source - 1 AND share > 0""")
def resize_weights(spark, sf):
    """The table function in a lateral join: weights of every pair of sizes that occurs."""
    tables.register(spark)
    source, target = (F.col("doc_id") % 9 + 1).alias("source"), (F.col("n_chars") % 7 + 1).alias("target")
    sizes = table(spark, sf, "documents").select(source, target).distinct()
    lateral = "SELECT source, target, o, s, round(k, 9) AS k FROM {sizes}, LATERAL resize_weights(cast(source as int), cast(target as int))"
    return spark.sql(lateral, sizes=sizes)


@query("q_resize_rows", f"""WITH {PX}, {axis_sql('wt', '[5, 12]')}, t AS (SELECT *, CASE image_id % 2 WHEN 0 THEN 5 ELSE 12 END AS n FROM px),
  across AS (SELECT t.image_id, t.n, t.y, wt.o AS x, sum(v * k) AS v FROM t JOIN wt ON wt.n = t.n AND wt.s = t.x GROUP BY 1, 2, 3, 4)
  SELECT image_id, wt.o AS y, x, round(sum(v * k), 6) AS v FROM across a JOIN wt ON wt.n = a.n AND wt.s = a.y GROUP BY 1, 2, 3""")
def resize_rows(spark, sf):
    """Resize by weights that the table function gives once per shape; they meet the images as image rows."""
    side = F.when(F.col("image_id") % 2 == 0, 5).otherwise(12)
    resized = pixels.resize_rows(image_rows(spark, sf), side, side)
    unit = pixels.gray_pixels(resized).withColumn("v", (F.col("v") + 1.0) / 2.0)
    return unit.select("image_id", "y", "x", F.round("v", 6).alias("v"))


@query("q_shrink_only", f"""WITH {PX}, {axis_sql('wt', '[6]')},
  across AS (SELECT image_id, y, wt.o AS x, sum(v * k) AS v FROM px JOIN wt ON wt.s = px.x GROUP BY 1, 2, 3)
  SELECT image_id, round(avg(v), 6) AS mean, count(*) AS n_pixels FROM (
    SELECT image_id, wt.o AS y, x, sum(v * k) AS v FROM across a JOIN wt ON wt.s = a.y GROUP BY 1, 2, 3) GROUP BY 1""")
def shrink_only(spark, sf):
    shrunk = pixels.resize(gray(spark, sf), *pixels.shrink_target(6), ["v"])
    return shrunk.groupBy("image_id").agg(F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("n_pixels"))


@query("q_match_size", f"""WITH {PX}, {axis_sql('wt', '[8, 6]')}, t AS (SELECT *, CASE WHEN image_id % 4 = 0 THEN 6 ELSE 8 END AS n FROM px),
  across AS (SELECT t.image_id, t.n, t.y, wt.o AS x, sum(v * k) AS v FROM t JOIN wt ON wt.n = t.n AND wt.s = t.x GROUP BY 1, 2, 3, 4),
  r AS (SELECT image_id, wt.o AS y, x, sum(v * k) AS v FROM across a JOIN wt ON wt.n = a.n AND wt.s = a.y GROUP BY 1, 2, 3)
  SELECT image_id, count(*) AS n_pixels, round(sum(v * (y + 1) * (x + 2)), 5) AS moment FROM r GROUP BY 1""")
def match_size(spark, sf):
    """High images follow the shape of their low image, or the training size when that is too small."""
    low_side = F.when(F.col("image_id") % 4 == 0, 4).otherwise(8)
    matched = pixels.resize(gray(spark, sf), *pixels.match_target(low_side, low_side, 6), ["v"])
    moment = F.sum(F.col("v") * (F.col("y") + 1) * (F.col("x") + 2))
    return matched.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_pixels"), F.round(moment, 5).alias("moment"))


@query("q_crop", f"""WITH {PX} SELECT image_id, (y - image_id % 4)::INT AS y, (x - image_id % 3)::INT AS x, v FROM px
  WHERE y BETWEEN image_id % 4 AND image_id % 4 + 4 AND x BETWEEN image_id % 3 AND image_id % 3 + 4""")
def crop(spark, sf):
    window = pixels.crop(gray(spark, sf), F.col("image_id") % 4, F.col("image_id") % 3, F.lit(5))
    return window.select("image_id", "y", "x", "v")


@query("q_hflip", f"WITH {PX} SELECT image_id, y, (CASE WHEN image_id % 2 = 1 THEN 7 - x ELSE x END)::INT AS x, v FROM px")
def hflip(spark, sf):
    return pixels.hflip(gray(spark, sf), F.col("image_id") % 2 == 1).select("image_id", "y", "x", "v")


@query("q_rotate", f"""WITH {PX}, o AS (SELECT image_id, y, x, radians((image_id % 11) - 5) AS t FROM px),
  src AS (SELECT image_id, y, x, (x - 3.5) * sin(t) + (y - 3.5) * cos(t) + 3.5 AS sy, (x - 3.5) * cos(t) - (y - 3.5) * sin(t) + 3.5 AS sx FROM o),
  taps AS (SELECT image_id, y, x, floor(sy)::INT + dy AS iy, floor(sx)::INT + dx AS ix,
    (1 - abs(sy - floor(sy) - dy)) * (1 - abs(sx - floor(sx) - dx)) AS k FROM src, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx))
  SELECT t.image_id, t.y, t.x, round(sum(coalesce(p.v, 0) * k), 6) AS v FROM taps t
  LEFT JOIN px p ON p.image_id = t.image_id AND p.y = t.iy AND p.x = t.ix GROUP BY 1, 2, 3""")
def rotate(spark, sf):
    turned = pixels.rotate(gray(spark, sf), (F.col("image_id") % 11 - 5).cast("double"), ["v"])
    return turned.select("image_id", "y", "x", F.round("v", 6).alias("v"))


FOLD = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query("q_blur", f"""WITH {PX}, g AS (SELECT j - 2 AS d, exp(-pow(j - 2, 2) / 2.88::DOUBLE) / (SELECT sum(exp(-pow(t - 2, 2) / 2.88::DOUBLE)) FROM range(5) r(t)) AS k FROM range(5) r(j)),
  w AS (SELECT o, {FOLD.format('o + d')} AS s, sum(k) AS k FROM range(8) r(o), g GROUP BY 1, 2),
  across AS (SELECT image_id, y, o AS x, sum(v * k) AS v FROM px JOIN w ON s = x GROUP BY 1, 2, 3)
  SELECT image_id, o AS y, x, round(sum(v * k), 6) AS v FROM across JOIN w ON s = y GROUP BY 1, 2, 3""")
def blur(spark, sf):
    soft = pixels.gaussian_blur(gray(spark, sf), F.lit(1.2), ["v"])
    return soft.select("image_id", "y", "x", F.round("v", 6).alias("v"))


@query("q_motion_blur", f"""WITH {PX}, p AS (SELECT vec_id AS image_id, CASE WHEN vec_id % 2 = 0 THEN 5 ELSE 3 END AS n, radians((vec_id % 18) * 10 + 3) AS t FROM embeddings),
  raw AS (SELECT image_id, n, dy, dx, greatest(0, 1 - abs(dx * sin(t) + dy * cos(t))) *
      greatest(0, least(1, least(dx * cos(t) - dy * sin(t) + n // 2 + 1, n - (dx * cos(t) - dy * sin(t) + n // 2)))) / n AS k
    FROM p, (SELECT unnest([-2, -1, 0, 1, 2]) AS dy), (SELECT unnest([-2, -1, 0, 1, 2]) AS dx) WHERE abs(dy) <= n // 2 AND abs(dx) <= n // 2),
  taps AS (SELECT image_id, dy, dx, k / (sum(k) OVER (PARTITION BY image_id) + 1e-8) AS k FROM raw),
  o AS (SELECT px.image_id, px.y, px.x, {FOLD.format('px.y + t.dy')} AS sy, {FOLD.format('px.x + t.dx')} AS sx, t.k FROM px JOIN taps t ON t.image_id = px.image_id)
  SELECT o.image_id, o.y, o.x, round(sum(q.v * o.k), 6) AS v FROM o JOIN px q ON q.image_id = o.image_id AND q.y = o.sy AND q.x = o.sx GROUP BY 1, 2, 3""")
def motion_blur(spark, sf):
    size = F.when(F.col("image_id") % 2 == 0, 5).otherwise(3)
    taps = pixels.motion_taps(size, (F.col("image_id") % 18 * 10 + 3).cast("double"))
    unpacked = pixels.gray_pixels(images(spark, sf).withColumn("taps", taps), keep=["taps"])
    moved = pixels.correlate(unpacked.withColumn("v", (F.col("v") + 1.0) / 2.0), "taps", ["v"])
    return moved.select("image_id", "y", "x", F.round("v", 6).alias("v"))
