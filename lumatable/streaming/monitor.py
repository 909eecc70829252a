"""Live monitoring of run logs with Structured Streaming.

Sinks write to the shared folder: nothing is gathered in driver memory. State per run is a few
numbers. Running figures are batch operators on micro-batches with a small state between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.operators import ordered, runs
from lumatable.operators.runs import FIRST_BEST
from lumatable.session import scratch_path
from lumatable.sources.run_files import LOG_COLUMNS, typed_log

BATCH, KIND = "_batch", "_kind"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A parquet table, one file or a folder of part files, as a stream of its files, a bounded number per micro-batch."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    # A stream reads folders; the file's own name selects it.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """Typed rows (run, pos, 32 columns) of growing CSV logs; header lines are dropped."""
    from lumatable.sources.growing_csv import GrowingLog

    spark.dataSource.register(GrowingLog)
    lines = spark.readStream.format("growing_log").option("path", pattern).load()
    schema = ", ".join(f"{name} string" for name in LOG_COLUMNS)
    parsed = lines.where(F.col("pos") > 0).select(
        F.regexp_replace("path", "/[^/]*$", "").alias("run"), "pos", F.from_csv("line", schema).alias("_row")
    )
    return typed_log(parsed.select("run", "pos", "_row.*"))


def latest_status(log: DataFrame, run: str, pos: str) -> DataFrame:
    """Latest row per run, for update mode."""
    return runs.latest_row(log, run, pos)


def windowed_throughput(log: DataFrame, run: str, ts: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows and mean value per run and time window."""
    return (
        log.withWatermark(ts, late)
        .groupBy(run, F.window(ts, width).alias("_w"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.avg(value).alias("mean_value"))
        .select(run, F.col("_w.start").alias("window_start"), "n_rows", "mean_value")
    )


class OrderedSteps:
    """Running figures of a stream whose rows have an order inside each run.

    Every micro-batch is a table, so the ordered operators work on it: a run that fills a micro-batch is
    cut into blocks and spread over tasks. From batch to batch go two small tables in the shared folder:
    the state (one row per run) and the rows that wait. A row waits until its run has come `lateness`
    positions further, so rows that arrive out of order by no more than that are put in their place, and
    the result is that of the batch query. A row that comes later still is kept apart (`late`), never
    dropped in silence.

    Each table is written per micro-batch into a folder of its own and read from the one before, so a
    micro-batch that is tried again gives the same tables.
    """

    def __init__(self, spark: SparkSession, label: str, columns: str, state: str, lateness: int):
        self.spark, self.base, self.lateness = spark, scratch_path(spark, label), lateness
        self.columns, self.state = columns, state

    def step(self, rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(results, new state of the runs in them) of rows (run, pos, metric) that follow the state."""
        raise NotImplementedError

    def _table(self, kind: str, batch: int, schema: str) -> DataFrame:
        """What a batch left; nothing before the first one."""
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{kind}/{BATCH}={batch}")

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.base}/{kind}/{BATCH}={batch}")

    def _placed(self, batch: int, kind: str) -> DataFrame:
        """Rows of a batch that were found ripe, waiting or late."""
        rows = self._table("rows", batch, f"{self.columns}, {KIND} string")
        return rows.where(F.col(KIND) == kind).drop(KIND)

    def late(self) -> DataFrame:
        """All rows that came too late to be put in their place."""
        rows = self.spark.read.schema(f"{self.columns}, {KIND} string").parquet(f"{self.base}/rows")
        return rows.where(F.col(KIND) == "late").drop(KIND, BATCH)

    def advance(self, rows: DataFrame, batch: int, everything: bool = False) -> None:
        state = self._table("state", batch - 1, f"run long, pos long, {self.state}")
        known = rows.where(F.col("metric").isNotNull() & ~F.isnan("metric")).unionByName(self._placed(batch - 1, "waiting"))
        seen = state.select(F.col("run").alias("_run"), F.col("pos").alias("_done"))
        fronts = known.groupBy("run").agg(F.max("pos").alias("_front")).join(seen, F.col("run") == F.col("_run"), "left").drop("_run")
        placed = ordered.join_facts(known, fronts, ["run"], ["pos"])
        ripe = F.lit(True) if everything else F.col("pos") <= F.col("_front") - self.lateness
        kind = F.when(F.col("pos") <= F.col("_done"), "late").when(ripe, "ripe").otherwise("waiting")
        self._write(placed.select(*known.columns, kind.alias(KIND)), "rows", batch)
        results, moved = self.step(self._placed(batch, "ripe"), state)
        self._write(results, "table", batch)
        self._write(state.join(moved.select("run"), "run", "left_anti").unionByName(moved), "state", batch)

    def run(self, stream: DataFrame) -> DataFrame:
        """Run over what is available, then let the waiting rows go; the results as a table."""
        query = (
            stream.writeStream.foreachBatch(self.advance)
            .option("checkpointLocation", f"{self.base}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        last = query.lastProgress["batchId"] if query.lastProgress else -1
        if last >= 0 and not self._placed(last, "waiting").isEmpty():
            self.advance(self.spark.createDataFrame([], self.columns), last + 1, everything=True)
        nothing = self.spark.createDataFrame([], self.results)
        return self.spark.read.parquet(f"{self.base}/table").select(*nothing.columns) if last >= 0 else nothing


class BestSoFar(OrderedSteps):
    """Rows that beat every earlier metric of their run."""

    results = "run long, pos long, metric double, best_before double"

    def __init__(self, spark: SparkSession, label: str, lateness: int):
        super().__init__(spark, label, "run long, pos long, metric double", "best double", lateness)

    def step(self, rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        scanned = ordered.running(rows, ["run"], "pos", {"_before": ("max", F.col("metric"))}, inclusive=False)
        bests = rows.groupBy("run").agg(F.max("pos").alias("pos"), F.max("metric").alias("_top"))
        held = bests.join(state.select("run", "best"), "run", "left")
        compared = ordered.join_facts(scanned, held.select("run", F.coalesce("best", F.lit(FIRST_BEST)).alias("_held")), ["run"], ["pos"])
        before = F.greatest("_held", F.coalesce("_before", F.col("_held")))
        hits = compared.withColumn("best_before", before).where(F.col("metric") > F.col("best_before"))
        moved = held.select("run", "pos", F.greatest(F.coalesce("best", F.lit(FIRST_BEST)), "_top").alias("best"))
        return hits.select("run", "pos", "metric", "best_before"), moved


class RunningAverage(OrderedSteps):
    """Exponential moving average per run; the first value seeds it."""

    results = "run long, pos long, ema double"

    def __init__(self, spark: SparkSession, label: str, lateness: int, decay: float = 0.98):
        super().__init__(spark, label, "run long, pos long, metric double", "ema double", lateness)
        self.decay = decay

    def step(self, rows: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
        averages = ordered.ema(rows, ["run"], "pos", {"ema": "metric"}, self.decay, before=state.select("run", "ema"))
        averages = averages.select("run", "pos", "ema")
        return averages, averages.groupBy("run").agg(F.max("pos").alias("pos"), F.max_by("ema", "pos").alias("ema"))


def running_bests(log: DataFrame, label: str = "stream-best", lateness: int = 0) -> DataFrame:
    """New-best events of a stream (run, pos, metric); blank metrics are no events."""
    return BestSoFar(log.sparkSession, label, lateness).run(log)


def running_ema(log: DataFrame, label: str = "stream-ema", lateness: int = 0, decay: float = 0.98) -> DataFrame:
    """Averages of a stream (run, pos, metric); rows with a blank metric have none."""
    return RunningAverage(log.sparkSession, label, lateness, decay).run(log)


def append_to_parquet(stream: DataFrame, label: str) -> DataFrame:
    """Run an append-mode stream over what is available; the written table as a batch."""
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def updates_to_parquet(stream: DataFrame, label: str) -> DataFrame:
    """Run an update-mode stream; the rows that changed, with the micro-batch that changed them.

    Each micro-batch owns a folder and overwrites it, so a batch that is tried again counts once.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{base}/table/{BATCH}={batch}"))
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema.add(BATCH, "long")).parquet(f"{base}/table")


def newest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key in a table of updates."""
    rest = [c for c in updates.columns if c not in (*keys, BATCH)]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_row")).select(*keys, "_row.*")
