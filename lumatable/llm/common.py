"""Helpers shared by the text operators: scratch tables, row keys, exact global ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumatable.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once under the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    # Empty inputs write no part file with a schema on some writers, so the schema is given.
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def content(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


_slot: dict = {}


def worker_state(key: tuple, make: Callable):
    """What a Python worker keeps from task to task: one object, whichever operator made it last."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
    return _slot[key]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of a row by content: repeated rows share it, rows with one id and other texts do not."""
    return F.xxhash64(F.col(doc_id), F.col(text), F.length(F.col(text)))


def with_global_rank(df: DataFrame, by: list[Column], name: str, label: str) -> DataFrame:
    """`df` with its exact position (from 0) in the order `by`.

    A range sort, then one count per partition; no task sees more than its range.
    """
    spark = df.sparkSession
    placed = materialize(
        df.repartitionByRange(shuffle_partitions(spark), *by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftrightunsigned("_at", LOCAL_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # One row per partition, so this window is small whatever the table's size.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << LOCAL_BITS) - 1))
        .drop("_part", "_start", "_at")
    )
