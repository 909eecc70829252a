"""Image-dataset catalogue: pairing, masks, limits, labels, skip-existing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumatable.functions import paths
from lumatable.operators import ordered

LABEL_IDS = "labelIds"
TRAIN_IDS = "trainIds"

# Class groups per label space.
CLASS_GROUPS = {
    LABEL_IDS: {
        "road": (6, 7, 8, 9, 10),
        "building": (11, 12, 13, 14, 15, 16, 17, 18),
        "light": (19,),
        "sign": (20,),
        "vegetation": (21, 22),
        "sky": (23,),
        "person": (24, 25),
        "vehicle": (26, 27, 28, 29, 30, 31, 32, 33),
    },
    TRAIN_IDS: {
        "road": (0, 1),
        "building": (2, 3, 4, 5),
        "light": (6,),
        "sign": (7,),
        "vegetation": (8, 9),
        "sky": (10,),
        "person": (11, 12),
        "vehicle": (13, 14, 15, 16, 17, 18),
    },
}
# Number of regular labels per space; 255 marks unlabelled pixels in both.
LABEL_COUNT = {LABEL_IDS: 34, TRAIN_IDS: 19}
UNLABELLED = 255


def class_groups(spark: SparkSession) -> DataFrame:
    """Dimension (label_space, class_group, label_id); a fixed 53 rows."""
    rows = [
        (space, group, label)
        for space, groups in CLASS_GROUPS.items()
        for group, labels in groups.items()
        for label in labels
    ]
    return spark.createDataFrame(rows, "label_space string, class_group string, label_id int")


def allowed_label(label: Column, space: str) -> Column:
    return label.between(0, LABEL_COUNT[space] - 1) | (label == UNLABELLED)


def pair_low_high(high: DataFrame, low: DataFrame, keys: list[str]) -> DataFrame:
    """High images that have a low image; high drives, names without a low file drop out."""
    return high.join(low, keys, "inner")


def missing_low(high: DataFrame, low: DataFrame, keys: list[str]) -> DataFrame:
    return high.join(low, keys, "left_anti")


def names_in_both(high: DataFrame, low: DataFrame, name: str = "name") -> DataFrame:
    return high.select(name).intersect(low.select(name))


def match_masks(images: DataFrame, masks: DataFrame, image_path: str, mask_path: str) -> DataFrame:
    """Mask at the same relative path, else <sample_id>.png; null mask_path when there is none.

    Both candidates are one row each, so a single equi-join on the path finds them.
    """
    same = F.concat(paths.without_suffix(F.col(image_path)), F.lit(".png"))
    flat = F.concat(paths.joined_id(F.col(image_path)), F.lit(".png"))
    candidates = images.withColumn("sample_id", paths.joined_id(F.col(image_path))).withColumn(
        "_candidate", F.explode(F.array_distinct(F.array(same, flat)))
    )
    known = masks.select(F.col(mask_path).alias("_candidate"), F.lit(True).alias("_found")).distinct()
    hits = candidates.join(known, "_candidate", "left")
    best = F.min(F.when(F.col("_found"), F.struct((F.col("_candidate") != same).alias("p"), F.col("_candidate"))))
    return hits.groupBy(image_path, "sample_id").agg(best.getField("_candidate").alias(mask_path))


def require_masks(matched: DataFrame, mask_path: str) -> DataFrame:
    """Fail the job on the first sample without a mask."""
    message = F.concat(F.lit("Mask not found for sample "), F.col("sample_id"))
    checked = F.when(F.col(mask_path).isNotNull(), F.col(mask_path)).otherwise(F.raise_error(message))
    return matched.withColumn(mask_path, checked)


def first_candidate(listed: DataFrame, root: str, name: str, candidates) -> DataFrame:
    """Per root the existing candidate of best priority; roots without one drop out."""
    place = F.array_position(F.array(*[F.lit(item) for item in candidates]), F.col(name))
    return (
        listed.where(F.col(name).isin(*candidates))
        .groupBy(root)
        .agg(F.min_by(name, place).alias("chosen"), F.min(place).cast("int").alias("priority"))
    )


def skip_existing(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work left over; apply before any image is decoded."""
    return todo.join(done, keys, "left_anti")


def count_by_dir(files: DataFrame, path: str, suffixes) -> DataFrame:
    kept = files.where(paths.has_suffix(F.col(path), suffixes))
    return kept.groupBy(paths.parent_dir(F.col(path)).alias("dir")).agg(F.count(F.lit(1)).alias("n_images"))


def shard_ids(rows: DataFrame, split: str, shard: str, row: str) -> DataFrame:
    """Sample ids from split, rank of the shard file within its split, and row in the file."""
    files = rows.select(split, shard).distinct()
    rank = F.dense_rank().over(Window.partitionBy(split).orderBy(shard)) - 1
    ranked = files.withColumn("shard_index", rank)
    return ordered.join_facts(rows, ranked, [split, shard], [row]).withColumn(
        "sample_id", paths.shard_sample_id(F.col(split), F.col("shard_index"), F.col(row))
    )


def split_limit(rows: DataFrame, split: str, order: list[str], limit: int) -> DataFrame:
    """First `limit` samples per split in shard and row order."""
    return ordered.top_rows(rows, [split], [F.col(name) for name in order], limit, spread=order)


def class_masks(pixels: DataFrame, groups: DataFrame, space: str, label: str = "label_id") -> DataFrame:
    """Class group and soft mask (confidence clipped to [0, 1]) of every labelled pixel."""
    chosen = groups.where(F.col("label_space") == space).select(F.col("label_id").alias(label), "class_group")
    mask = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("confidence"), F.lit(1.0))))
    return pixels.join(F.broadcast(chosen), label, "left").withColumn(
        "mask", F.when(F.col("class_group").isNotNull(), mask).otherwise(0.0)
    )


def class_coverage(pixels: DataFrame, groups: DataFrame, space: str, image: str, label: str = "label_id") -> DataFrame:
    """Share of an image's pixels per class group, one column per group."""
    chosen = groups.where(F.col("label_space") == space).select(F.col("label_id").alias(label), "class_group")
    shares = [
        (F.count_if(F.col("class_group") == name) / F.count(F.lit(1))).alias(f"{name}_share")
        for name in CLASS_GROUPS[space]
    ]
    return pixels.join(F.broadcast(chosen), label, "left").groupBy(image).agg(*shares)


LABEL_VALUES = 256  # label maps are 8-bit
WORD_BITS = 64


def label_words(label: str = "label_id") -> list[Column]:
    """Aggregates that hold which 8-bit labels occur, as the bits of four numbers."""
    return [
        F.coalesce(
            F.bit_or(F.when(F.floor(F.col(label) / WORD_BITS) == word, F.expr(f"shiftleft(1L, cast(pmod({label}, {WORD_BITS}) as int))"))),
            F.lit(0).cast("long"),
        ).alias(f"_labels{word}")
        for word in range(LABEL_VALUES // WORD_BITS)
    ]


def labels_in(words: list[str]) -> Column:
    """The labels whose bits are set, in order."""

    def of(word: int, name: str) -> Column:
        first = word * WORD_BITS
        values = F.sequence(F.lit(first), F.lit(first + WORD_BITS - 1))
        return F.filter(values, lambda value: F.getbit(F.col(name), value - first) == 1)

    return F.concat(*[of(word, name) for word, name in enumerate(words)])


def distinct_labels(pixels: DataFrame, image: str, label: str = "label_id") -> DataFrame:
    """(image, labels): the labels that occur in each image, in order.

    A partial aggregate of a task is one row per image: four numbers hold the labels 0 to 255, and a set
    what other values there are. No row per image and label is shuffled.
    """
    value = F.col(label).cast("int")
    rows = pixels.select(image, value.alias(label))
    other = F.collect_set(F.when((F.col(label) < 0) | (F.col(label) >= LABEL_VALUES), F.col(label))).alias("_other")
    words = label_words(label)
    held = rows.groupBy(image).agg(*words, other)
    names = [f"_labels{word}" for word in range(len(words))]
    return held.select(image, F.array_sort(F.concat(labels_in(names), "_other")).alias("labels"))


def invalid_labels(pixels: DataFrame, space: str, image: str, label: str = "label_id", shown: int = 10) -> DataFrame:
    """Images with labels outside the space: how many, and the first ones in order."""
    bad = F.filter("labels", lambda v: ~allowed_label(v, space))
    return (
        distinct_labels(pixels, image, label)
        .select(image, bad.alias("_bad"))
        .where(F.size("_bad") > 0)
        .select(
            image,
            F.size("_bad").cast("long").alias("n_invalid"),
            F.array_join(F.slice("_bad", 1, shown).cast("array<string>"), ",").alias("invalid"),
        )
    )


def require_labels(pixels: DataFrame, space: str, label: str = "label_id") -> DataFrame:
    """Fail the job on the first label outside the space."""
    message = F.concat(F.lit(f"Unsupported label for {space}: "), F.col(label).cast("string"))
    checked = F.when(allowed_label(F.col(label), space), F.col(label)).otherwise(F.raise_error(message))
    return pixels.withColumn(label, checked)


def group_overlap(groups: DataFrame, space: str, group: str = "class_group", label: str = "label_id") -> DataFrame:
    """Labels claimed by more than one group, or not allowed in the space at all."""
    return (
        groups.select(group, label)
        .distinct()
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n_groups"), F.array_join(F.array_sort(F.collect_list(group)), ",").alias("groups"))
        .withColumn("allowed", allowed_label(F.col(label), space).cast("int"))
        .where((F.col("n_groups") > 1) | (F.col("allowed") == 0))
    )
