"""Files a training run leaves behind, read for all runs under a root at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.functions import parsing, paths
from lumatable.operators import runs

# Columns of the metric log, in file order.
LOG_COLUMNS = (
    "step", "epoch", "phase", "loss", "lr", "l_diff", "l_x0", "l_wavelet", "l_frequency", "l_edge", "x0_w",
    "l_ret", "l_recon_low", "l_recon_high", "l_consistency", "l_exposure", "l_tv", "data_time",
    "compute_time", "iter_time", "data_wait_ratio", "samples_per_sec", "cpu_percent", "cpu_rss_gb",
    "gpu_allocated_gb", "gpu_reserved_gb", "gpu_max_reserved_gb", "val_psnr", "val_ssim", "val_lpips",
    "val_seconds_per_image", "val_step_count",
)
WHOLE_COLUMNS = ("step", "epoch", "val_step_count")
LOG_NAME, STATUS_NAME, CONFIG_NAME = "training_metrics.csv", "training_status.json", "resolved_config.json"
REPORT_NAME, FULL_REPORT = "metrics.txt", "full_eval/metrics.txt"


def run_of(path: Column, name: str) -> Column:
    """Run folder of a file with a known relative name."""
    return F.regexp_replace(path, "/" + name.replace(".", r"\.") + "$", "")


def log_position() -> Column:
    """Place of a row in its text file, as one growing number.

    The block of the file comes first, the row within its task second; a file is
    cut into blocks of far more than 4096 bytes.
    """
    block = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), 12), 33)
    return block.bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def typed_log(rows: DataFrame) -> DataFrame:
    """Text columns of the log to numbers; blank and None become null."""
    return rows.withColumns(
        {
            name: (parsing.safe_int if name in WHOLE_COLUMNS else parsing.safe_float)(F.col(name))
            for name in LOG_COLUMNS
            if name != "phase"
        }
    )


def read_logs(spark: SparkSession, root: str) -> DataFrame:
    """(run, pos, 32 columns) of every training_metrics.csv under a root."""
    schema = ", ".join(f"{name} string" for name in LOG_COLUMNS)
    rows = (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", LOG_NAME)
        .csv(root)
    )
    return typed_log(rows.select(run_of(F.col("_metadata.file_path"), LOG_NAME).alias("run"), log_position().alias("pos"), *LOG_COLUMNS))


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """(run, source, report text); source 1 is the full evaluation, 2 the run's own report."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", REPORT_NAME)
    files = reader.text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    full = path.endswith("/" + FULL_REPORT)
    return files.select(
        F.when(full, run_of(path, FULL_REPORT)).otherwise(run_of(path, REPORT_NAME)).alias("run"),
        F.when(full, 1).otherwise(2).alias("source"),
        path.alias("path"),
        F.col("value").alias("text"),
    )


def _read_json(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
    rows = reader.option("pathGlobFilter", name).json(root)
    return rows.select(F.col("_metadata.file_path").alias("path"), *[c for c in rows.columns])


def read_status(spark: SparkSession, root: str) -> DataFrame:
    """(run, val_psnr, val_ssim, val_lpips, step); values that are no numbers are null."""
    rows = _read_json(spark, root, STATUS_NAME, "val_psnr string, val_ssim string, val_lpips string, step string")
    return rows.select(
        run_of(F.col("path"), STATUS_NAME).alias("run"),
        *[parsing.safe_float(F.col(name)).alias(name) for name in ("val_psnr", "val_ssim", "val_lpips")],
        parsing.safe_int(F.col("step")).alias("step"),
    )


def read_configs(spark: SparkSession, root: str) -> DataFrame:
    """(run, args, summary) as text maps of every resolved configuration."""
    rows = _read_json(spark, root, CONFIG_NAME, "args map<string,string>, summary map<string,string>")
    return rows.select(run_of(F.col("path"), CONFIG_NAME).alias("run"), "args", "summary")


def read_checkpoint_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(run, path, step, best_psnr) of checkpoint folders; best_psnr only when it is a number in the file."""
    rows = _read_json(spark, root, "checkpoint_metadata.json", "best_psnr double")
    folder = run_of(F.col("path"), "checkpoint_metadata.json")
    listed = rows.select(paths.parent_dir(folder).alias("run"), folder.alias("path"), "best_psnr")
    return runs.checkpoints(listed, "run", "path")


def read_model_metadata(spark: SparkSession, root: str) -> DataFrame:
    """(model, args) from the first metadata file of each model folder."""
    rows = _read_json(spark, root, "*metadata.json", "args map<string,string>")
    name = paths.base_name(F.col("path"))
    place = F.array_position(parsing.strings(paths.METADATA_CANDIDATES), name)
    known = rows.where(place > 0).select(paths.parent_dir(F.col("path")).alias("model"), place.alias("place"), "args")
    return known.groupBy("model").agg(F.min_by("args", "place").alias("args"))


def primary_metrics(spark: SparkSession, root: str, preferred: int = runs.PREFERRED_STEPS) -> DataFrame:
    """One row per run: metrics of its best source and the chosen section.

    A report counts when it has a section at all; the status file when it has any
    of its four values.
    """
    files = read_reports(spark, root)
    lines = runs.report_lines(files, "path", "text")
    sections = runs.report_sections(lines, "path")
    chosen = runs.pick_step(sections, ["path"], "step_count", preferred)
    values = (
        runs.parse_report(lines, "path")
        .withColumnRenamed("step_count", "primary_step")
        .groupBy("path", "primary_step")
        .pivot("metric", ["psnr", "ssim", "lpips", "secondsperimage"])
        .agg(F.first("value"))
        .withColumnRenamed("secondsperimage", "seconds_per_image")
    )
    fields = ["primary_step", "psnr", "ssim", "lpips", "seconds_per_image"]
    reports = (
        files.select("run", "source", "path").join(chosen, "path").join(values, ["path", "primary_step"], "left")
    ).select("run", "source", F.col("path").alias("metrics_source"), *fields)
    status = read_status(spark, root)
    any_value = F.coalesce("val_psnr", "val_ssim", "val_lpips", F.col("step").cast("double")).isNotNull()
    snapshots = status.where(any_value).select(
        "run",
        F.lit(3).alias("source"),
        F.concat("run", F.lit("/" + STATUS_NAME)).alias("metrics_source"),
        F.lit(preferred).cast("bigint").alias("primary_step"),
        F.col("val_psnr").alias("psnr"),
        F.col("val_ssim").alias("ssim"),
        F.col("val_lpips").alias("lpips"),
        F.lit(None).cast("double").alias("seconds_per_image"),
    )
    every = reports.unionByName(snapshots)
    best = F.min_by(F.struct("metrics_source", *fields), "source").alias("_best")
    return every.groupBy("run").agg(best).select("run", "_best.*")


def summarize_runs(
    spark: SparkSession, root: str, window: int = runs.TAIL_WINDOW, preferred: int = runs.PREFERRED_STEPS,
    priority=runs.PHASE_PRIORITY,
) -> DataFrame:
    """The full summary of every run under a root, one row per run."""
    log = read_logs(spark, root)
    tail = runs.phase_tail(log, "run", "phase", "pos", window, priority)
    means = runs.tail_means(
        tail,
        "run",
        {
            "throughput_mean": F.col("samples_per_sec"),
            "wait_ratio_mean": F.col("data_wait_ratio"),
            "cpu_percent_mean": F.col("cpu_percent"),
            "gpu_reserved_mean": F.col("gpu_reserved_gb"),
        },
        {"gpu_reserved_max": F.col("gpu_reserved_gb")},
    )
    latest = log.groupBy("run").agg(F.max_by("step", "pos").alias("latest_step"))
    logged = means.join(latest, "run")
    return (
        logged.join(primary_metrics(spark, root, preferred), "run", "full")
        .join(read_configs(spark, root).select("run", F.col("summary").alias("config")), "run", "full")
        .withColumn("name", paths.base_name(F.col("run")))
        .withColumn("sampled_rows", F.coalesce("sampled_rows", F.lit(0)))
    )


def summary_lines(summary: DataFrame) -> DataFrame:
    """(run, lines): each summary rendered as text."""
    fields = {
        "run_dir": (F.col("run"), None),
        "metrics_source": (F.col("metrics_source"), None),
        "sampled_phase": (F.col("sampled_phase"), None),
        "sampled_rows": (F.col("sampled_rows"), None),
        "latest_step": (F.col("latest_step"), None),
        "primary_step": (F.col("primary_step"), None),
        "samples_per_sec_mean": (F.col("throughput_mean"), 3),
        "data_wait_ratio_mean": (F.col("wait_ratio_mean"), 3),
        "cpu_percent_mean": (F.col("cpu_percent_mean"), 1),
        "gpu_reserved_mean_gb": (F.col("gpu_reserved_mean"), 2),
        "gpu_reserved_max_gb": (F.col("gpu_reserved_max"), 2),
        "psnr": (F.col("psnr"), 4),
        "ssim": (F.col("ssim"), 4),
        "lpips": (F.col("lpips"), 4),
        "seconds_per_image": (F.col("seconds_per_image"), 6),
    }
    keys = {
        "config": "config_name",
        "effective_batch": "effective_batch_size",
        "resolution": "resolution",
        "decom": "decom_variant",
        "condition": "condition_variant",
    }
    config = runs.config_line({name: F.try_element_at("config", F.lit(key)) for name, key in keys.items()})
    text = runs.summary_text(F.col("name"), fields)
    has_config = F.coalesce(F.size("config"), F.lit(0)) > 0
    return summary.select("run", F.when(has_config, F.concat_ws("\n", text, config)).otherwise(text).alias("lines"))
