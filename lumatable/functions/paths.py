"""File-name predicates and sample ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image suffixes per caller.
PAIR_SUFFIXES = ("png", "jpg", "jpeg", "bmp")
DEGRADE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tiff")
MASKED_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "webp", "tif", "tiff")
ASSET_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "webp")

# Splits, the two image roots of a raw dataset tree, output folders per split.
SPLITS = ("train", "val", "test")
TREE_ROOTS = ("leftImg8bit", "gtFine")
LAYOUT = {"train": "our485", "val": "eval15", "test": "test"}

# Candidate folders in order of preference.
TRAIN_CANDIDATES = ("our485", "train")
EVAL_CANDIDATES = ("eval15", "val")
METADATA_CANDIDATES = ("metadata.json", "final_metadata.json", "best_metadata.json")

SLOW_MOUNT = "/mnt/"


def has_suffix(name: Column, suffixes=PAIR_SUFFIXES) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(suffixes) + r")$")


def without_suffix(path: Column) -> Column:
    """Drop the last suffix of the last component; dot-files keep their name."""
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def joined_id(relative: Column) -> Column:
    """Relative path without suffix, folders joined by double underscores."""
    return F.replace(without_suffix(relative), F.lit("/"), F.lit("__"))


def tree_sample_id(path: Column, root: str) -> Column:
    """Sample id in a raw dataset tree: image root and split folder are dropped."""
    bare = F.regexp_replace(relative_to(path, root), "^(" + "|".join(TREE_ROOTS) + ")/", "")
    bare = F.regexp_replace(bare, "^(" + "|".join(SPLITS) + ")/(?=.)", "")
    return joined_id(bare)


def shard_sample_id(split: Column, shard: Column, row: Column) -> Column:
    return F.format_string("%s__shard%02d__row%05d", split, shard, row)


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def normal_split(split: Column) -> Column:
    """Lower-case split name, or null when it is not one of the known splits."""
    lowered = F.lower(split)
    return F.when(lowered.isin(*SPLITS), lowered)


def layout_dir(split: Column) -> Column:
    pairs = [F.lit(part) for item in LAYOUT.items() for part in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), split), split)


def on_slow_mount(path: Column) -> Column:
    return path.startswith(SLOW_MOUNT)


def checkpoint_step(name: Column) -> Column:
    """Step of a checkpoint-<step> folder; null for any other name."""
    return F.regexp_extract(name, r"^checkpoint-(\d+)$", 1).try_cast("bigint")
