"""Run analytics over many runs at once: tails, bests, summaries, reports, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatable.functions import parsing, paths
from lumatable.operators import ordered

# Phases looked for first in a run's log, in order.
PHASE_PRIORITY = ("joint", "decom_warmup")
TAIL_WINDOW = 20
PREFERRED_STEPS = 8
FIRST_BEST = -1.0

# Keys of a validation report and the number of decimals each is written with.
REPORT_FIELDS = (
    ("PSNR", "psnr", 4),
    ("SSIM", "ssim", 4),
    ("SecondsPerImage", "seconds_per_image", 6),
    ("LPIPS", "lpips", 4),
    ("SemanticDistance", "semantic_distance", 4),
    ("NIQE", "niqe", 4),
)
MIN_EFFECTIVE_BATCH = 16


def phase_tail(
    log: DataFrame, run: str, phase: str, pos: str, window: int = TAIL_WINDOW, priority=PHASE_PRIORITY
) -> DataFrame:
    """Last `window` rows of the best phase present in a run, else of the whole run.

    Adds sampled_phase. Rows are classed by priority, all other phases being one
    last class: a run without a named phase has all its rows there. The tail of
    every class is cut before anything is shuffled; the choice sees a few rows per run.
    """
    known = F.array(*[F.lit(name) for name in priority])
    place = F.coalesce(F.nullif(F.array_position(known, F.col(phase)), F.lit(0)), F.lit(len(priority) + 1))
    tails = ordered.top_rows(log.withColumn("_place", place), [run, "_place"], [F.col(pos).desc()], window, spread=[pos])
    return (
        tails.withColumn("_best", F.min("_place").over(Window.partitionBy(run)))
        .where(F.col("_place") == F.col("_best"))
        .withColumn("sampled_phase", F.get(known, (F.col("_place") - 1).cast("int")))
        .drop("_place", "_best")
    )


def tail_means(tail: DataFrame, run: str, means: dict[str, Column], maxima: dict[str, Column]) -> DataFrame:
    """Means and maxima over a tail; nulls are left out, a run without values gets null."""
    return tail.groupBy(run).agg(
        *[F.avg(expr).alias(name) for name, expr in means.items()],
        *[F.max(expr).alias(name) for name, expr in maxima.items()],
        F.count(F.lit(1)).alias("sampled_rows"),
        F.max("sampled_phase").alias("sampled_phase"),
    )


def latest_row(log: DataFrame, run: str, pos: str) -> DataFrame:
    """Last line of each run's log by position, whatever its step or phase."""
    rest = [name for name in log.columns if name != run]
    last = F.max_by(F.struct(*rest), F.col(pos)).alias("_row")
    return log.groupBy(run).agg(last).select(run, "_row.*")


def new_bests(log: DataFrame, run: str, pos: str, metric: str) -> DataFrame:
    """Rows whose metric beats every earlier one of the run."""
    best = ordered.running(log, [run], pos, {"best_before": ("max", F.col(metric))}, inclusive=False)
    before = F.coalesce(F.col("best_before"), F.lit(FIRST_BEST))
    return best.withColumn("best_before", before).where(F.col(metric) > F.col("best_before"))


def carry_forward(log: DataFrame, run: str, pos: str, values: dict[str, Column]) -> DataFrame:
    """Last known values repeated on the rows that follow."""
    return ordered.running(log, [run], pos, {name: ("last", expr) for name, expr in values.items()})


def long_numeric(log: DataFrame, ids: list[str], columns: list[str], variable: str, value: str) -> DataFrame:
    """Wide text columns to long rows, keeping numeric values only."""
    texts = log.select(*ids, *[F.col(name).cast("string").alias(name) for name in columns])
    melted = texts.unpivot(ids, columns, variable, "_text")
    return melted.withColumn(value, parsing.safe_float(F.col("_text"))).where(F.col(value).isNotNull()).drop("_text")


def logged_rows(log: DataFrame, step: str, interval: int, terminal: Column | None = None) -> DataFrame:
    """First step, every interval-th step, and from the terminal step on."""
    every = F.col(step) % max(1, interval) == 0
    keep = (F.col(step) <= 1) | every
    return log.where(keep if terminal is None else keep | (F.col(step) >= terminal))


def throughput(data_time: Column, compute_time: Column, samples: Column, processes: int = 1) -> dict[str, Column]:
    total = F.greatest(data_time + compute_time, F.lit(1e-8))
    return {
        "iter_time": total,
        "data_wait_ratio": data_time / total,
        "samples_per_sec": samples * max(1, processes) / total,
    }


def accumulate(log: DataFrame, run: str, pos: str, steps: int, sums: dict[str, Column]) -> DataFrame:
    """Micro-batches summed per update step of `steps` consecutive rows."""
    micro = ordered.numbered(log, [run], pos, "_micro", start=0)
    update = F.floor(F.col("_micro") / steps).cast("bigint").alias("update_step")
    return micro.groupBy(run, update).agg(
        *[F.sum(expr).alias(name) for name, expr in sums.items()], F.count(F.lit(1)).alias("micro_batches")
    )


def baseline_delta(runs: DataFrame, baseline: DataFrame, metrics: list[str]) -> DataFrame:
    """Difference and ratio of every run to one baseline row, read as scalar subqueries."""
    changes = {}
    for name in metrics:
        base = baseline.select(name).scalar()
        changes[f"{name}_delta"] = F.col(name) - base
        changes[f"{name}_ratio"] = F.col(name) / F.nullif(base, F.lit(0.0)) - 1.0
    return runs.withColumns(changes)


def job_outcome(results: DataFrame, keys: list[str], ok: Column, elapsed: Column) -> DataFrame:
    """Processed, failed and succeeded items, and items per second."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~ok).alias("failed"),
        F.count_if(ok).alias("succeeded"),
        (F.count(F.lit(1)) / F.greatest(elapsed, F.lit(1e-8))).alias("items_per_sec"),
    )


def seconds_per_image(timings: DataFrame, run: str, batch: str, elapsed: str, images: Column) -> DataFrame:
    """Slowest elapsed time per batch, summed and divided by the number of images."""
    slowest = timings.groupBy(run, batch).agg(F.max(elapsed).alias("_slow"), images.alias("_images"))
    return slowest.groupBy(run).agg((F.sum("_slow") / F.sum("_images")).alias("seconds_per_image"))


def tail_lines(lines: DataFrame, file: str, pos: str, n: int) -> DataFrame:
    return ordered.top_rows(lines, [file], [F.col(pos).desc()], n, spread=[pos])


def checkpoints(listing: DataFrame, run: str, path: str) -> DataFrame:
    """Folders named checkpoint-<step>, with their step."""
    step = paths.checkpoint_step(paths.base_name(F.col(path)))
    return listing.withColumn("step", step).where(F.col("step").isNotNull())


def latest_checkpoint(found: DataFrame, run: str, path: str) -> DataFrame:
    return found.groupBy(run).agg(
        F.max("step").alias("step"), F.max_by(path, "step").alias(path), F.count(F.lit(1)).alias("n_checkpoints")
    )


def stale_checkpoints(found: DataFrame, run: str, keep: int) -> DataFrame:
    """Checkpoints beyond the newest `keep` per run: those to delete."""
    newest = ordered.top_rows(found, [run], [F.col("step").desc()], keep, spread=["step"])
    oldest_kept = newest.groupBy(run).agg(F.min("step").alias("_oldest_kept"))
    joined = ordered.join_facts(found, oldest_kept, [run], ["step"])
    return joined.where(F.col("step") < F.col("_oldest_kept")).select(*found.columns)


def pick_step(rows: DataFrame, keys: list[str], step: str, preferred: int = PREFERRED_STEPS) -> DataFrame:
    """Preferred step count where present, else the smallest."""
    rank = F.struct((F.col(step) != preferred).alias("other"), F.col(step).alias("step"))
    return rows.groupBy(*keys).agg(F.min(rank).getField("step").alias("primary_step"))


def report_lines(files: DataFrame, file: str, text: str) -> DataFrame:
    """Whole report texts to numbered, stripped lines."""
    return files.select(file, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "_raw")).select(
        file, F.col("pos").cast("bigint").alias("pos"), parsing.stripped(F.col("_raw")).alias("line")
    )


def parse_report(lines: DataFrame, file: str, pos: str = "pos", line: str = "line") -> DataFrame:
    """(file, step_count, metric, value) from sectioned report lines.

    A header is filled down to its lines. A repeated section starts empty, so only
    lines under the last header of a step count are read; there the last number wins.
    """
    header = F.regexp_extract(F.col(line), r"^\[steps=(-?\d+)\]$", 1).try_cast("bigint")
    marked = lines.withColumn("_steps", header).withColumn(
        "_at", F.when(F.col("_steps").isNotNull(), F.col(pos))
    )
    filled = ordered.running(
        marked, [file], pos, {"step_count": ("last", F.col("_steps")), "_section": ("last", F.col("_at"))}
    )
    final = (
        marked.where(F.col("_steps").isNotNull())
        .groupBy(file, F.col("_steps").alias("step_count"))
        .agg(F.max(pos).alias("_section"))
    )
    key = F.regexp_extract(F.col(line), r"^([^:]*):", 1)
    value = parsing.safe_float(F.regexp_extract(F.col(line), r"^[^:]*:(.*)$", 1))
    entries = (
        filled.where(F.col("_steps").isNull() & F.col(line).contains(":") & ~F.col(line).startswith("Step:"))
        .withColumn("metric", parsing.metric_key(key))
        .withColumn("value", value)
        .where(F.col("value").isNotNull() & F.col("step_count").isNotNull())
    )
    return (
        entries.join(final, [file, "step_count", "_section"], "left_semi")
        .groupBy(file, "step_count", "metric")
        .agg(F.max_by("value", pos).alias("value"))
    )


def report_sections(lines: DataFrame, file: str, line: str = "line") -> DataFrame:
    """Step counts that have a header, also those whose section stays empty."""
    header = F.regexp_extract(F.col(line), r"^\[steps=(-?\d+)\]$", 1).try_cast("bigint")
    return lines.select(file, header.alias("step_count")).where(F.col("step_count").isNotNull()).distinct()


def report_step(lines: DataFrame, file: str, pos: str = "pos", line: str = "line") -> DataFrame:
    """Training step of a report: its last Step: line, null when that is no number."""
    step = parsing.safe_int(F.regexp_extract(F.col(line), r"^Step:(.*)$", 1))
    return (
        lines.where(F.col(line).startswith("Step:"))
        .groupBy(file)
        .agg(F.max_by(step, F.col(pos)).alias("train_step"))
    )


def parse_report_cards(lines: DataFrame, file: str, pos: str = "pos", line: str = "line") -> DataFrame:
    """The report read flat: sections ignored, a later number replaces an earlier one.

    Only the three card metrics are shown and a line must hold a single colon.
    """
    key = F.regexp_extract(F.col(line), r"^([^:]*):[^:]*$", 1)
    card = F.when(key.contains("PSNR"), "PSNR").when(key.contains("SSIM"), "SSIM").when(key.contains("LPIPS"), "LPIPS")
    value = parsing.safe_float(F.regexp_extract(F.col(line), r"^[^:]*:([^:]*)$", 1))
    return (
        lines.select(file, pos, card.alias("card"), value.alias("value"))
        .where(F.col("card").isNotNull() & F.col("value").isNotNull())
        .groupBy(file, "card")
        .agg(F.max_by("value", pos).alias("value"))
    )


def section_text(step_count: Column, metrics: dict[str, Column]) -> Column:
    """One report section; the first three values are always written, the others when known."""
    lines = [F.format_string("[steps=%d]", step_count)]
    for title, name, digits in REPORT_FIELDS:
        if name in metrics:
            lines.append(F.concat(F.lit(f"{title}: "), parsing.fixed_point(metrics[name], digits)))
            if name not in ("psnr", "ssim", "seconds_per_image"):
                lines[-1] = F.when(metrics[name].isNotNull(), lines[-1])
    return F.concat_ws("\n", *lines)


def report_text(sections: DataFrame, file: str, order: str, section: str, step: Column) -> DataFrame:
    """Whole report per file from one row per section; sections are as few as step counts."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, section))), lambda s: s[section]), "\n\n")
    tail = F.concat(F.lit("\nStep: "), F.coalesce(F.max(step).cast("string"), F.lit("None")), F.lit("\n"))
    return sections.groupBy(file).agg(F.concat(body, tail).alias("report"))


def metric_source(facts: DataFrame, run: str, priority: Column, pos: Column, fields: list[str]) -> DataFrame:
    """Metrics of a run from its best source; within it the latest row."""
    best = F.min(F.struct(priority.alias("priority"), (-pos).alias("late"), *fields)).alias("_best")
    return facts.groupBy(run).agg(best).select(run, "_best.priority", *[f"_best.{name}" for name in fields])


def summary_text(run: Column, fields: dict[str, tuple[Column, int | None]]) -> Column:
    """Rendered run summary; None as digits shows a value as it is."""
    lines = [F.concat(F.lit("["), run, F.lit("]"))]
    for name, (value, digits) in fields.items():
        shown = parsing.whole_text(value) if digits is None else parsing.number_text(value, digits)
        lines.append(F.concat(F.lit(f"{name}: "), shown))
    return F.concat_ws("\n", *lines)


def config_line(config: dict[str, Column]) -> Column:
    """The config_summary line added when a run has a resolved configuration."""
    parts = [F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("None"))) for name, value in config.items()]
    return F.concat(F.lit("config_summary: "), F.concat_ws(" ", *parts))


def validation_plan(requests: DataFrame, default_steps: Column) -> DataFrame:
    """Rows (…, step_count, metric): what a validation computes, in order of the request.

    requests has `fast`, the asked `metrics`, and lists of step counts `fast_steps` and `steps`. A fast
    validation takes the asked metrics (PSNR and SSIM always), a full one all that are supported; the default
    step count is always among the step counts.
    """
    names = F.when(F.col("fast"), parsing.metric_names(F.col("metrics"))).otherwise(parsing.strings(parsing.SUPPORTED_METRICS))
    counts = parsing.step_counts(F.when(F.col("fast"), F.col("fast_steps")).otherwise(F.col("steps")), default_steps)
    planned = requests.withColumn("step_count", F.explode(counts))
    return planned.withColumn("metric", F.explode(names)).drop("metrics", "fast_steps", "steps")
