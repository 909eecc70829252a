"""Partitioned writes with skip-existing, report and snapshot writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lumatable.operators.catalog import skip_existing


def _existing(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """Keys already written; None when there is no table yet."""
    try:
        return spark.read.parquet(path).select(*keys)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


BUCKET = "_bucket"


def _placed(samples: DataFrame, keys: list[str], partition: str, buckets: int) -> tuple[DataFrame, list[str]]:
    """Samples with the columns that name their folder."""
    if not buckets:
        return samples, [partition]
    own = [F.coalesce(F.col(key).cast("string"), F.lit("")) for key in keys if key != partition]
    return samples.withColumn(BUCKET, F.pmod(F.xxhash64(*own), F.lit(buckets)).cast("int")), [partition, BUCKET]


def _stored(spark: SparkSession, path: str, like: DataFrame, folders: list[str]) -> DataFrame | None:
    """The table at a path, its folder columns with the types that the samples have; None when there is none."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    types = dict(like.dtypes)
    return found.withColumns({c: F.col(c).cast(types[c]) for c in folders})


def replace_samples(samples: DataFrame, path: str, keys: list[str], partition: str, buckets: int = 0) -> None:
    """Put samples in the place of those with the same keys; every other sample stays.

    Only folders that a new sample goes to are read and written again: what they hold besides the new
    keys is kept by an anti-join on the keys alone, so that data is shuffled only if the new keys are too
    many to broadcast. Spark stages the folders and swaps them in when the whole job has succeeded; a
    job that fails leaves the table as it was.

    A sample is known by its partition and keys; null keys are equal. Keys should be unique within a call.
    """
    placed, folders = _placed(samples, keys, partition, buckets)
    stored = _stored(samples.sparkSession, path, placed, folders)
    if stored is not None:
        # One row per folder that is written anyway; Spark prunes the other folders by it.
        touched = [row.asDict() for row in placed.select(*folders).distinct().collect()]
        held = F.lit(False)
        for value in {row[partition] for row in touched}:
            here = F.col(partition).eqNullSafe(F.lit(value))
            if buckets:
                here &= F.col(BUCKET).isin([row[BUCKET] for row in touched if row[partition] == value])
            held |= here
        named = list(dict.fromkeys([*folders, *keys]))
        new = placed.select(*[F.col(c).alias(f"_new_{c}") for c in named]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_new_{c}")) for c in named]
        placed = stored.where(held).join(new, same, "left_anti").unionByName(placed, allowMissingColumns=True)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def export_samples(
    samples: DataFrame, path: str, keys: list[str], partition: str, overwrite: bool = False, buckets: int = 0
) -> DataFrame:
    """Write samples that are not there yet, partitioned; returns samples per partition value.

    With overwrite, samples that are there are replaced one by one (`replace_samples`). With buckets, the
    folders of a partition value are cut by a hash of the keys into so many, so that a replacement
    rewrites only its share of a large table; a table keeps the number it was first written with.
    """
    if overwrite:
        replace_samples(samples, path, keys, partition, buckets)
    else:
        placed, folders = _placed(samples, keys, partition, buckets)
        done = _existing(samples.sparkSession, path, keys)
        fresh = placed if done is None else skip_existing(placed, done, keys)
        fresh.write.mode("append").partitionBy(*folders).parquet(path)
    return samples.groupBy(partition).agg(F.count(F.lit(1)).alias("n_samples"))


def write_triplet(
    samples: DataFrame, path: str, ident: str, kinds: dict[str, str], overwrite: bool = False, buckets: int = 0
) -> None:
    """High, semantic and low data of each sample as kind=... partitions, each skipped or replaced on its own.

    kinds maps a kind to the column that holds its data.
    """
    long = samples.select(
        ident, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("data")) for k, c in kinds.items()])).alias("_k")
    ).select(ident, "_k.kind", "_k.data")
    export_samples(long, path, [ident, "kind"], "kind", overwrite, buckets)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Append log rows; every file carries its own header."""
    rows.write.mode("append").option("header", "true").option("nullValue", "").csv(path)


def write_status(latest: DataFrame, path: str) -> None:
    """Replace the snapshot: one JSON object per run."""
    latest.write.mode("overwrite").json(path)


def write_reports(reports: DataFrame, path: str, run: str = "run", text: str = "report") -> None:
    """One text file set per run folder."""
    reports.select(run, F.col(text).alias("value")).write.mode("overwrite").partitionBy(run).text(path)
