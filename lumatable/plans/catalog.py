"""Catalogue queries: page URLs stand for file paths, documents for high images, labels for low images and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumatable.functions import parsing, paths
from lumatable.operators import catalog, ordered
from lumatable.plans.registry import query, table
from lumatable.session import scratch_path
from lumatable.sources import sinks

KINDS = ["png", "JPG", "jpeg", "bmp", "TIFF", "webp", "txt"]

FILES = """files AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/' || page_id || '.' ||
  ['png', 'JPG', 'jpeg', 'bmp', 'TIFF', 'webp', 'txt'][1 + page_id % 7] AS path FROM pages)"""


def files(spark, sf):
    """Image-like paths, one per page."""
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    kind = F.element_at(parsing.strings(KINDS), (F.col("page_id") % 7 + 1).cast("int"))
    path = F.concat(bare, F.lit("/"), F.col("page_id").cast("string"), F.lit("."), kind)
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


@query("q_scan_filter", f"""WITH {FILES} SELECT page_id, path,
  CAST(regexp_matches(lower(path), '\\.(png|jpg|jpeg|bmp|tiff)$') AS INTEGER) AS degradable,
  CAST(starts_with(CASE WHEN page_id % 2 = 0 THEN '/mnt/' ELSE '/data/' END || path, '/mnt/') AS INTEGER) AS slow
  FROM files WHERE regexp_matches(lower(path), '\\.(png|jpg|jpeg|bmp|webp|tif|tiff)$')""")
def scan_filter(spark, sf):
    found = files(spark, sf).where(paths.has_suffix(F.col("path"), paths.MASKED_SUFFIXES))
    mount = F.when(F.col("page_id") % 2 == 0, "/mnt/").otherwise("/data/")
    return found.select(
        "page_id",
        "path",
        paths.has_suffix(F.col("path"), paths.DEGRADE_SUFFIXES).cast("int").alias("degradable"),
        paths.on_slow_mount(F.concat(mount, F.col("path"))).cast("int").alias("slow"),
    )


TREE = f"""{FILES}, tree AS (SELECT page_id, path, '/root/' || CASE page_id % 3 WHEN 0 THEN 'leftImg8bit/' WHEN 1 THEN 'gtFine/' ELSE '' END ||
  CASE page_id % 4 WHEN 0 THEN 'train/' WHEN 1 THEN 'val/' WHEN 2 THEN 'test/' ELSE 'extra/' END || path AS full_path FROM files)"""


@query("q_sample_id", f"""WITH {TREE} SELECT page_id,
  replace(regexp_replace(regexp_replace(regexp_replace(replace(full_path, '/root/', ''), '^(leftImg8bit|gtFine)/', ''),
    '^(train|val|test)/', ''), '\\.[^./]+$', ''), '/', '__') AS tree_id,
  replace(regexp_replace(path, '\\.[^./]+$', ''), '/', '__') AS masked_id FROM tree""")
def sample_id(spark, sf):
    root = F.element_at(parsing.strings(["leftImg8bit/", "gtFine/", ""]), (F.col("page_id") % 3 + 1).cast("int"))
    split = F.element_at(parsing.strings(["train/", "val/", "test/", "extra/"]), (F.col("page_id") % 4 + 1).cast("int"))
    full = F.concat(F.lit("/root/"), root, split, F.col("path"))
    return files(spark, sf).select(
        "page_id",
        paths.tree_sample_id(full, "/root").alias("tree_id"),
        paths.joined_id(F.col("path")).alias("masked_id"),
    )


@query("q_count_by_dir", f"""WITH {FILES} SELECT regexp_replace(path, '/[^/]*/[^/]*$', '') AS dir, count(*) AS n_images FROM files
  WHERE regexp_matches(lower(path), '\\.(png|jpg|jpeg|bmp|tiff)$') GROUP BY 1""")
def count_by_dir(spark, sf):
    # One level up: every page has its own folder.
    lifted = files(spark, sf).withColumn(
        "path", F.concat(paths.parent_dir(paths.parent_dir(F.col("path"))), F.lit("/"), paths.base_name(F.col("path")))
    )
    return catalog.count_by_dir(lifted, "path", paths.DEGRADE_SUFFIXES)


@query("q_first_candidate", f"""WITH {FILES}, listed AS (SELECT split_part(path, '/', 1) AS root,
    CASE page_id % 5 WHEN 0 THEN 'our485' WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'misc' END AS name FROM files)
  SELECT root, CASE WHEN max(CAST(name = 'our485' AS INTEGER)) = 1 THEN 'our485' ELSE 'train' END AS chosen,
    CASE WHEN max(CAST(name = 'our485' AS INTEGER)) = 1 THEN 1 ELSE 2 END AS priority
  FROM listed WHERE name IN ('our485', 'train') GROUP BY root""")
def first_candidate(spark, sf):
    names = parsing.strings(["our485", "train", "val", "misc", "misc"])
    listed = files(spark, sf).select(
        F.split_part("path", F.lit("/"), F.lit(1)).alias("root"),
        F.element_at(names, (F.col("page_id") % 5 + 1).cast("int")).alias("name"),
    )
    return catalog.first_candidate(listed, "root", "name", paths.TRAIN_CANDIDATES)


def samples(spark, sf):
    """Documents as dataset samples: split = language, shard = source, row = position in the shard."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("split"), F.col("source").alias("shard"))
    return ordered.numbered(rows, ["split", "shard"], "doc_id", "row", start=0)


SAMPLES = """samples AS (SELECT doc_id, lang AS split, source AS shard,
  row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1 AS row FROM documents)"""


@query("q_shard_ids", f"""WITH {SAMPLES} SELECT doc_id, split || '__shard' ||
  printf('%02d', dense_rank() OVER (PARTITION BY split ORDER BY shard) - 1) || '__row' || printf('%05d', row) AS sample_id FROM samples""")
def shard_ids(spark, sf):
    return catalog.shard_ids(samples(spark, sf), "split", "shard", "row").select("doc_id", "sample_id")


@query("q_split_limit", f"""WITH {SAMPLES} SELECT split, shard, row, doc_id FROM (SELECT *,
  row_number() OVER (PARTITION BY split ORDER BY shard, row) AS rn FROM samples) WHERE rn <= 25""")
def split_limit(spark, sf):
    return catalog.split_limit(samples(spark, sf), "split", ["shard", "row"], 25).select("split", "shard", "row", "doc_id")


@query("q_split_counts", """SELECT d.lang AS split, count(*) AS n_samples, count(l.doc_id) AS n_masks
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""")
def split_counts(spark, sf):
    masks = table(spark, sf, "labels").select("doc_id", F.lit(1).alias("has_mask"))
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.col("lang").alias("split"))
        .join(masks, "doc_id", "left")
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("n_samples"), F.count("has_mask").alias("n_masks"))
    )


SPLIT_NAMES = ["train", "VAL", "Test", "extra"]


@query("q_layout_map", """SELECT doc_id, CASE lang WHEN 'en' THEN 'our485' WHEN 'de' THEN 'eval15' WHEN 'es' THEN 'test' ELSE lang END AS subset FROM documents""")
def layout_map(spark, sf):
    split = F.when(F.col("lang") == "en", "train").when(F.col("lang") == "de", "val").when(F.col("lang") == "es", "test")
    split = F.coalesce(split, F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", paths.layout_dir(split).alias("subset"))


@query("q_validate_enum", """SELECT CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'VAL' WHEN 2 THEN 'Test' ELSE 'extra' END AS given,
  CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' END AS split, count(*) AS n FROM documents GROUP BY 1, 2""")
def validate_enum(spark, sf):
    given = F.element_at(parsing.strings(SPLIT_NAMES), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf, "documents").select(given.alias("given"), paths.normal_split(given).alias("split"))
    return rows.groupBy("given", "split").agg(F.count(F.lit(1)).alias("n"))


def high(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.format_string("img%06d.png", "doc_id").alias("name"), F.col("lang").alias("split"))


def low(spark, sf):
    return table(spark, sf, "labels").select(F.format_string("img%06d.png", "doc_id").alias("name"), "quality")


@query("q_pair_join", """SELECT printf('img%06d.png', d.doc_id) AS name, d.lang AS split, 'low/' || printf('img%06d.png', l.doc_id) AS low_path,
  'high/' || printf('img%06d.png', d.doc_id) AS high_path FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def pair_join(spark, sf):
    lows = low(spark, sf).select("name", F.concat(F.lit("low/"), "name").alias("low_path"))
    pairs = catalog.pair_low_high(high(spark, sf), lows, ["name"])
    return pairs.withColumn("high_path", F.concat(F.lit("high/"), "name"))


@query("q_pair_missing", """SELECT printf('img%06d.png', doc_id) AS name, lang AS split FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pair_missing(spark, sf):
    return catalog.missing_low(high(spark, sf), low(spark, sf), ["name"])


@query("q_names_intersect", """SELECT printf('img%06d.png', doc_id) AS name FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)""")
def names_intersect(spark, sf):
    return catalog.names_in_both(high(spark, sf), low(spark, sf))


@query("q_mask_join", """SELECT d.lang || '/' || d.source || '/' || d.doc_id || '.jpg' AS image, d.lang || '__' || d.source || '__' || d.doc_id AS sample_id,
  CASE WHEN l.quality = 1 THEN d.lang || '/' || d.source || '/' || d.doc_id || '.png'
    WHEN l.quality = 0 THEN d.lang || '__' || d.source || '__' || d.doc_id || '.png' END AS mask
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def mask_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    folder = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    images = docs.select(F.concat(folder, F.lit(".jpg")).alias("image"))
    same, flat = F.concat(folder, F.lit(".png")), F.concat(F.replace(folder, F.lit("/"), F.lit("__")), F.lit(".png"))
    masks = (
        docs.join(table(spark, sf, "labels"), "doc_id").select(F.when(F.col("quality") == 1, same).otherwise(flat).alias("mask"))
    )
    return catalog.match_masks(images, masks, "image", "mask")


@query("q_skip_existing", """WITH kinds AS (SELECT doc_id, unnest(['high', 'semantic', 'low']) AS kind FROM documents),
  done AS (SELECT doc_id, 'high' AS kind FROM labels UNION ALL SELECT doc_id, 'semantic' FROM labels WHERE quality = 1
    UNION ALL SELECT doc_id, 'low' FROM labels WHERE toxic = 0 AND quality = 1)
  SELECT k.doc_id, k.kind FROM kinds k WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.doc_id = k.doc_id AND d.kind = k.kind)""")
def skip_existing(spark, sf):
    kinds = F.explode(parsing.strings(["high", "semantic", "low"])).alias("kind")
    todo = table(spark, sf, "documents").select("doc_id", kinds)
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    written = F.array(F.lit("high"), F.when(good, "semantic"), F.when(good & clean, "low"))
    done = table(spark, sf, "labels").select("doc_id", F.explode(F.array_compact(written)).alias("kind"))
    return catalog.skip_existing(todo, done, ["doc_id", "kind"])


@query("q_export_overwrite", """SELECT lang AS split, doc_id AS sample_id, CASE WHEN doc_id % 3 = 0 THEN -n_chars ELSE n_chars END AS data FROM documents""")
def export_overwrite(spark, sf):
    """Every document is exported; every third is then replaced, and what is there already is skipped."""
    rows = table(spark, sf, "documents").select(F.col("lang").alias("split"), F.col("doc_id").alias("sample_id"), F.col("n_chars").alias("data"))
    path, where = scratch_path(spark, "export"), {"keys": ["split", "sample_id"], "partition": "split", "buckets": 4}
    sinks.export_samples(rows, path, **where)
    again = rows.where("sample_id % 3 = 0").withColumn("data", -F.col("data"))
    sinks.export_samples(again, path, **where, overwrite=True)
    sinks.export_samples(rows.withColumn("data", F.lit(0).cast("long")), path, **where)
    return spark.read.parquet(path).select("split", "sample_id", "data")


@query("q_triplet_overwrite", """SELECT doc_id AS sample_id, kind, CASE WHEN doc_id % 4 = 1 AND kind <> 'high' THEN -1
    WHEN kind = 'high' THEN n_chars WHEN kind = 'semantic' THEN doc_id % 19 ELSE n_chars // 2 END AS data
  FROM documents, (SELECT unnest(['high', 'semantic', 'low']) AS kind)""")
def triplet_overwrite(spark, sf):
    """Three kinds of data per document; two kinds of every fourth document are replaced."""
    chars = F.col("n_chars")
    data = {"high": chars, "semantic": F.col("doc_id") % 19, "low": F.floor(chars / 2)}
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"), *[v.alias(f"d_{k}") for k, v in data.items()])
    path = scratch_path(spark, "triplet")
    sinks.write_triplet(rows, path, "sample_id", {k: f"d_{k}" for k in data})
    none = F.lit(-1).cast("long")
    again = rows.where("sample_id % 4 = 1").withColumns({"d_semantic": none, "d_low": none})
    sinks.write_triplet(again, path, "sample_id", {k: f"d_{k}" for k in ("semantic", "low")}, overwrite=True)
    return spark.read.parquet(path).select("sample_id", "kind", "data")


@query("q_number_outputs", f"""WITH {FILES} SELECT path, printf('enhanced_%05d.png', row_number() OVER (ORDER BY path) - 1) AS output FROM files""")
def number_outputs(spark, sf):
    indexed = ordered.global_index(files(spark, sf).select("path"), ["path"])
    return indexed.select("path", F.format_string("enhanced_%05d.png", "index").alias("output"))


# Label maps: an order is an image, its lines are labelled pixels.
LABELS = "px AS (SELECT l_orderkey AS image_id, CAST(l_partkey % 34 AS INTEGER) AS label_id, l_quantity / 40 AS confidence FROM lineitem)"
GROUP_IDS = {name: ids for name, ids in catalog.CLASS_GROUPS[catalog.LABEL_IDS].items()}
GROUP_CASE = "CASE " + " ".join(
    f"WHEN label_id IN ({', '.join(map(str, ids))}) THEN '{name}'" for name, ids in GROUP_IDS.items()
) + " END"


def label_pixels(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        (F.col("l_partkey") % 34).cast("int").alias("label_id"),
        (F.col("l_quantity") / 40).alias("confidence"),
    )


@query("q_class_coverage", f"WITH {LABELS} SELECT image_id, " + ", ".join(
    f"round(count(*) FILTER (label_id IN ({', '.join(map(str, ids))})) / count(*), 6) AS {name}_share"
    for name, ids in GROUP_IDS.items()
) + " FROM px GROUP BY image_id")
def class_coverage(spark, sf):
    groups = catalog.class_groups(spark)
    shares = catalog.class_coverage(label_pixels(spark, sf), groups, catalog.LABEL_IDS, "image_id")
    return shares.select("image_id", *[F.round(name, 6).alias(name) for name in shares.columns[1:]])


@query("q_class_mask", f"""WITH {LABELS} SELECT image_id, label_id, {GROUP_CASE} AS class_group,
  CASE WHEN {GROUP_CASE} IS NULL THEN 0 ELSE greatest(0, least(1, confidence)) END AS mask FROM px""")
def class_mask(spark, sf):
    masks = catalog.class_masks(label_pixels(spark, sf), catalog.class_groups(spark), catalog.LABEL_IDS)
    return masks.select("image_id", "label_id", "class_group", "mask")


@query("q_invalid_labels", f"""WITH {LABELS}, bad AS (SELECT DISTINCT image_id, label_id FROM px WHERE NOT (label_id BETWEEN 0 AND 18 OR label_id = 255))
  SELECT image_id, count(*) AS n_invalid, array_to_string(list_sort(list(label_id))[1:10], ',') AS invalid FROM bad GROUP BY image_id""")
def invalid_labels(spark, sf):
    return catalog.invalid_labels(label_pixels(spark, sf), catalog.TRAIN_IDS, "image_id")


@query("q_group_overlap", """WITH claims AS (SELECT DISTINCT l_returnflag AS class_group, CAST(l_suppkey % 40 AS INTEGER) AS label_id FROM lineitem)
  SELECT label_id, count(*) AS n_groups, string_agg(class_group, ',' ORDER BY class_group) AS groups,
    CAST(label_id BETWEEN 0 AND 18 OR label_id = 255 AS INTEGER) AS allowed
  FROM claims GROUP BY label_id HAVING count(*) > 1 OR NOT (label_id BETWEEN 0 AND 18 OR label_id = 255)""")
def group_overlap(spark, sf):
    claims = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("class_group"), (F.col("l_suppkey") % 40).cast("int").alias("label_id")
    )
    return catalog.group_overlap(claims, catalog.TRAIN_IDS)
