"""Layered and nested configuration."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumatable.functions import parsing

# Configuration layers, strongest first.
PRECEDENCE = ("cli", "launch", "yaml", "builtin")

# Keys of the flat runtime summary.
SUMMARY_KEYS = (
    "mode", "config_name", "config_path", "data_dir", "output_dir", "model_path", "mixed_precision",
    "resolution", "batch_size", "gradient_accumulation_steps", "effective_batch_size",
    "min_effective_batch_size", "num_workers", "prefetch_factor", "persistent_workers", "pin_memory",
    "decode_cache_size", "opencv_threads_per_worker", "validation_steps", "num_validation_images",
    "num_inference_steps", "benchmark_inference_steps", "train_fast_validation", "train_validation_metrics",
    "train_validation_benchmark_steps", "use_retinex", "conditioning_space", "inject_mode", "decom_variant",
    "condition_variant", "loss_balance_mode", "frequency_loss_weight", "edge_loss_weight",
    "semantic_backbone", "nr_metric", "attention_backend", "use_torch_compile", "torch_compile_mode",
    "enable_torch_sdpa_memory_efficient_attention", "resolved_unet_backend", "resume",
)


def merge_layers(entries: DataFrame, run: str, layer: str, key: str, value: str, pos: str) -> DataFrame:
    """Value of each key from the strongest layer that sets it; within a layer the last entry.

    One partial aggregate: layers are never joined to each other.
    """
    place = F.array_position(F.array(*[F.lit(name) for name in PRECEDENCE]), F.col(layer))
    best = F.min(F.struct(place.alias("place"), (-F.col(pos)).alias("late"), F.col(layer), F.col(value)))
    return (
        entries.where(F.col(value).isNotNull() & (place > 0))
        .groupBy(run, key)
        .agg(best.alias("_best"))
        .select(run, key, f"_best.{layer}", f"_best.{value}")
    )


# What a summary says about the order of its layers.
PRECEDENCE_TEXT = (
    "CLI explicit args",
    "shell/UI explicit launch overrides",
    "configs/train/*.yaml defaults",
    "built-in train defaults only when values are absent",
)

# The lines of a printed summary, as pieces of text and the keys whose values follow them.
LINE_PREFIX = "[config-summary] "
SUMMARY_LINES = (
    (("mode=", "mode"), (" config=", "config_name"), (" config_path=", "config_path")),
    (("data_dir=", "data_dir"), (" output_dir=", "output_dir")),
    (
        ("batch_size=", "batch_size"), (" grad_accum=", "gradient_accumulation_steps"),
        (" effective_batch=", "effective_batch_size"), (" min_effective_batch=", "min_effective_batch_size"),
    ),
    (
        ("loader=num_workers:", "num_workers"), (" prefetch_factor:", "prefetch_factor"),
        (" persistent_workers:", "persistent_workers"), (" pin_memory:", "pin_memory"),
        (" decode_cache_size:", "decode_cache_size"), (" opencv_threads_per_worker:", "opencv_threads_per_worker"),
    ),
    (
        ("validation=steps:", "validation_steps"), (" num_validation_images:", "num_validation_images"),
        (" num_inference_steps:", "num_inference_steps"), (" benchmark_inference_steps:", "benchmark_inference_steps"),
    ),
    (
        ("train_validation=fast:", "train_fast_validation"), (" metrics:", "train_validation_metrics"),
        (" steps:", "train_validation_benchmark_steps"),
    ),
    (("data=source_low_high_pairs augmentation:torchvision_random_crop_rotate_flip", None),),
    (
        ("model=use_retinex:", "use_retinex"), (" decom_variant:", "decom_variant"), (" condition_variant:", "condition_variant"),
        (" conditioning_space:", "conditioning_space"), (" inject_mode:", "inject_mode"),
    ),
    (("loss=balance_mode:", "loss_balance_mode"), (" frequency:", "frequency_loss_weight"), (" edge:", "edge_loss_weight")),
    (
        ("backend=requested:", "attention_backend"), (" compile:", "use_torch_compile"), (" compile_mode:", "torch_compile_mode"),
        (" sdpa_requested:", "enable_torch_sdpa_memory_efficient_attention"), (" resolved:", "resolved_unet_backend"),
    ),
)


def json_entries(text: Column) -> Column:
    """Top-level entries of a JSON object; nested objects stay JSON text."""
    return F.from_json(text, "map<string,string>")


class _Written(str):
    """A JSON number as it stands in the text."""


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON value")


def _as_json(value) -> str:
    if isinstance(value, _Written):
        return value
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_as_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_as_json, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def leaves(text: str | None) -> dict[str, str | None]:
    """Leaf keys of a JSON object in order; a key met later replaces an earlier one, however deep each is."""
    try:
        found = json.loads(text or "", parse_int=_Written, parse_float=_Written, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return {}
    flat: dict[str, str | None] = {}
    open_objects = [iter(found.items())] if isinstance(found, dict) else []
    while open_objects:
        key, value = next(open_objects[-1], (None, None))
        if key is None:
            open_objects.pop()
        elif isinstance(value, dict):
            open_objects.append(iter(value.items()))
        else:
            flat[key] = value if value is None or isinstance(value, str) else _as_json(value)
    return flat


_LEAF = T.StructType([T.StructField(name, T.StringType()) for name in ("key", "value")])


@F.pandas_udf(T.ArrayType(_LEAF))
def _leaves(texts: pd.Series) -> pd.Series:
    found = [[{"key": k, "value": None if v is None else str(v)} for k, v in leaves(text).items()] for text in texts]
    return pd.Series(found, dtype=object)


def flatten_json(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Leaf keys of nested JSON objects, however deep, in one pass without a shuffle; a later branch wins.

    Later means later in the text. Strings stay strings even where they look like an object, numbers
    stay as written, lists are JSON text; empty objects have no leaves, and text that is no JSON object
    has none. Each row is flattened on its own.
    """
    return df.select(ident, F.inline(_leaves(F.col(text))))


def effective_batch(batch: Column, accumulation: Column) -> Column:
    """Samples per update; null when either part is missing."""
    both = F.greatest(F.lit(1), batch) * F.greatest(F.lit(1), accumulation)
    return F.when(batch.isNotNull() & accumulation.isNotNull(), both)


def config_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")


def runtime_summary(df: DataFrame, args: str, keep: list[str]) -> DataFrame:
    """Flat record of the summary keys from a map column of arguments.

    A preset's name stands for its file; a name that was removed fails the job with a message.
    """

    def arg(name: str) -> Column:
        return F.try_element_at(F.col(args), F.lit(name))

    config = arg("config")
    path = F.when(F.coalesce(config, F.lit("")) == "", config).otherwise(parsing.known_preset_path(config))
    derived = {
        "config_name": F.coalesce(F.nullif(arg("config_name"), F.lit("")), config_stem(F.nullif(path, F.lit("")))),
        "config_path": path,
        "effective_batch_size": F.coalesce(
            F.nullif(arg("effective_batch_size").try_cast("bigint"), F.lit(0).cast("bigint")),
            effective_batch(
                arg("batch_size").try_cast("bigint"), arg("gradient_accumulation_steps").try_cast("bigint")
            ),
        ),
        "benchmark_inference_steps": F.coalesce(arg("benchmark_inference_steps"), F.lit("[]")),
        "resolved_unet_backend": arg("unet_backend_resolved_backend"),
    }
    order = F.array(*[F.lit(text) for text in PRECEDENCE_TEXT]).alias("config_precedence")
    return df.select(*keep, *[derived.get(name, arg(name)).alias(name) for name in SUMMARY_KEYS], order)


def summary_text(summary: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, at, line): the printed lines of each summary; null is None, JSON's words are written with capitals."""

    def shown(name: str) -> Column:
        value = F.col(name).cast("string")
        words = F.when(value == "true", "True").when(value == "false", "False").otherwise(value)
        return F.coalesce(words, F.lit("None"))

    lines = [
        F.concat(F.lit(LINE_PREFIX), *[part for text, name in line for part in (F.lit(text), *([shown(name)] if name else []))])
        for line in SUMMARY_LINES
    ]
    return summary.select(*keep, F.posexplode(F.array(*lines)).alias("at", "line"))


def record_json(names: list[str]) -> Column:
    """Columns as one JSON object; nulls are written."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
