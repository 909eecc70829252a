"""Preset files (JSON or YAML), flattened and summarised as a table."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumatable.operators import config


@F.pandas_udf(StringType())
def yaml_as_json(texts: pd.Series) -> pd.Series:
    """YAML documents as JSON text; needs the yaml module on the executors."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML presets needs the yaml module; JSON presets do not") from error
    return texts.map(lambda text: json.dumps(yaml.safe_load(text) or {}))


def read_presets(spark: SparkSession, root: str, kind: str = "json") -> DataFrame:
    """(name, key, value) leaf settings of every preset of one kind ("json" or "yaml") under a root."""
    files = spark.read.option("pathGlobFilter", f"*.{kind}").text(root, wholetext=True)
    text = yaml_as_json("value") if kind == "yaml" else F.col("value")
    named = files.select(config.config_stem(F.col("_metadata.file_path")).alias("name"), text.alias("value"))
    return config.flatten_json(named, "name", "value")


def preset_summary(leaves: DataFrame) -> DataFrame:
    """One row per preset: size, resolution, batch and effective batch."""
    wide = leaves.groupBy(F.col("name").alias("preset")).pivot(
        "key", ["name", "description", "target_vram_gb", "resolution", "batch_size", "gradient_accumulation_steps"]
    ).agg(F.first("value"))
    batch = F.coalesce(F.col("batch_size").try_cast("int"), F.lit(1))
    steps = F.coalesce(F.col("gradient_accumulation_steps").try_cast("int"), F.lit(1))
    return wide.select(
        F.coalesce("name", "preset").alias("name"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("target_vram_gb", F.lit("-")).alias("target_vram_gb"),
        F.coalesce("resolution", F.lit("-")).alias("resolution"),
        batch.alias("batch_size"),
        steps.alias("gradient_accumulation_steps"),
        (batch * steps).alias("effective_batch"),
    )
