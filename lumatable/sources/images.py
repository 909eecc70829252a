"""Image files, parquet shards and dataset trees as tables."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lumatable.functions import paths


def list_files(spark: SparkSession, root: str, suffixes=paths.PAIR_SUFFIXES) -> DataFrame:
    """(path, length): names only, file contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return listed.where(paths.has_suffix(F.col("path"), suffixes)).select("path", "length")


def list_assets(spark: SparkSession, root: str) -> DataFrame:
    """Sky assets under a root; no rows when the folder does not exist."""
    try:
        return list_files(spark, root, paths.ASSET_SUFFIXES)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length bigint")


def resolve_split(spark: SparkSession, root: str, candidates: tuple[str, ...], kinds: tuple[str, ...] = ("low", "high")) -> str:
    """The first candidate folder below a root that has a folder of every kind; else an error that lists them all.

    Folders are looked for by a glob, one listing per candidate and kind; no file is opened.
    """

    def there(path: str) -> bool:
        try:
            spark.read.format("binaryFile").load(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False
        return True

    for name in candidates:
        if all(there(f"{root}/{name}/{kind}") for kind in kinds):
            return f"{root}/{name}"
    expected = ", ".join(f"{root}/{name}/{{{','.join(kinds)}}}" for name in candidates)
    raise FileNotFoundError(f"No folder with {' and '.join(kinds)}. Expected one of: {expected}")


def relative_path(root: str) -> Column:
    """Path below a root, whatever scheme the listing puts in front; the root is taken literally."""
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?"
    bare = re.sub(scheme, "", root).rstrip("/")
    # A relative root is looked for behind a slash, an absolute one at the start.
    front = "^" if bare.startswith("/") else "^(?:.*?/)?"
    return F.regexp_replace(F.regexp_replace("path", scheme, ""), f"{front}\\Q{bare}\\E/", "")


def paired_files(spark: SparkSession, root: str, subset: str, suffixes=paths.PAIR_SUFFIXES) -> DataFrame:
    """(name, low_path, high_path) of a low/high split; names without a low file drop out."""

    def side(kind: str) -> DataFrame:
        # Direct children only: the pair list does not descend into folders.
        files = spark.read.format("binaryFile").load(f"{root}/{subset}/{kind}")
        kept = files.where(paths.has_suffix(F.col("path"), suffixes))
        return kept.select(paths.base_name(F.col("path")).alias("name"), F.col("path").alias(f"{kind}_path"))

    return side("high").join(side("low"), "name").select("name", "low_path", "high_path")


def masked_files(spark: SparkSession, split_root: str) -> tuple[DataFrame, DataFrame]:
    """Relative image and mask paths of a split with images/ and masks/ folders."""
    images = list_files(spark, f"{split_root}/images", paths.MASKED_SUFFIXES)
    masks = list_files(spark, f"{split_root}/masks", ("png",))
    return (
        images.select(relative_path(f"{split_root}/images").alias("image")),
        masks.select(relative_path(f"{split_root}/masks").alias("mask")),
    )


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images (path, h, w, channels, data): data holds row-major BGR bytes.

    A file that cannot be decoded has ok = 0 instead of failing the job.
    """
    image = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*")
    return image.select(
        F.col("origin").alias("path"),
        F.col("height").alias("h"),
        F.col("width").alias("w"),
        F.col("nChannels").alias("channels"),
        "data",
        (F.col("nChannels") > 0).cast("int").alias("ok"),
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda held: None if held is None else np.frombuffer(held, np.uint8).astype(np.int32))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Interleaved RGB of row-major BGR (or BGRA, or grey) bytes."""

    def one(held: bytes, n: int) -> np.ndarray:
        pixels = np.frombuffer(held, np.uint8).reshape(-1, n).astype(np.int32)
        return (pixels[:, 2::-1] if n >= 3 else np.repeat(pixels[:, :1], 3, axis=1)).reshape(-1)

    return pd.Series([one(*row) for row in zip(data, channels, strict=True)], dtype=object)


def byte_values(data: Column) -> Column:
    """Binary column to an array of whole numbers 0-255."""
    return _bytes(data)


def rgb_arrays(images: DataFrame, ident: Column) -> DataFrame:
    """(image_id, h, w, data) with interleaved 8-bit RGB from decoded images; grey is repeated."""
    decoded = images.where(F.col("ok") == 1)
    return decoded.select(ident.alias("image_id"), "h", "w", _rgb("data", "channels").alias("data"))


def label_pixels(images: DataFrame, ident: Column) -> DataFrame:
    """(image_id, h, w, y, x, label_id) from decoded label maps; the first channel holds the label."""
    decoded = images.where(F.col("ok") == 1).select(
        ident.alias("image_id"), "h", "w", "channels", byte_values(F.col("data")).alias("_bytes")
    )
    places = F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    labels = F.transform(places, lambda i: F.get("_bytes", i * F.col("channels")))
    flat = decoded.select("image_id", "h", "w", F.posexplode(labels).alias("_i", "label_id"))
    return flat.select(
        "image_id", "h", "w", F.floor(F.col("_i") / F.col("w")).cast("int").alias("y"),
        (F.col("_i") % F.col("w")).cast("int").alias("x"), "label_id",
    )


def read_shards(spark: SparkSession, root: str, split: str) -> DataFrame:
    """Parquet shards data/<split>-*.parquet: (split, shard, row, image bytes, mask bytes)."""
    rows = spark.read.parquet(f"{root}/data/{split}-*.parquet")
    return rows.select(
        F.lit(split).alias("split"),
        F.col("_metadata.file_name").alias("shard"),
        F.col("_metadata.row_index").alias("row"),
        F.col("image.bytes").alias("image"),
        F.col("semantic_segmentation.bytes").alias("mask"),
    )


def read_tree(spark: SparkSession, root: str, split: str, mode: str = "fine") -> DataFrame:
    """(split, sample_id, source_path, mask_source_path) of a raw dataset tree.

    Images are leftImg8bit/<split>/<city>/<stem>_leftImg8bit.png; the target has
    the same stem under gtFine or gtCoarse.
    """
    if mode not in ("fine", "coarse"):
        raise ValueError(f"Unsupported mode: {mode}")
    truth = "gtFine" if mode == "fine" else "gtCoarse"
    images = list_files(spark, f"{root}/leftImg8bit/{split}", ("png",))
    targets = list_files(spark, f"{root}/{truth}/{split}", ("png",))
    stem = r"([^/]+/[^/]+)_%s\.png$"
    left = images.select(
        F.regexp_extract("path", stem % "leftImg8bit", 1).alias("_stem"), F.col("path").alias("source_path"),
        paths.tree_sample_id(relative_path(root), root).alias("sample_id"),
    )
    right = targets.select(
        F.regexp_extract("path", stem % f"{truth}_labelIds", 1).alias("_stem"), F.col("path").alias("mask_source_path")
    ).where(F.col("_stem") != "")
    return left.join(right, "_stem").select(F.lit(split).alias("split"), "sample_id", "source_path", "mask_source_path")
