"""Run analytics on the event log: run = user_id, phase = event_type, position = event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatable.functions import parsing
from lumatable.operators import config, ordered, runs
from lumatable.plans.registry import query, table

# The phase names of this log, searched in this order for the tail.
PRIORITY = ("purchase", "click")
EMA_DECAY = 0.98


def log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a metric log; the payload holds one number."""
    payload = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("pos"),
        F.col("event_type").alias("phase"),
        F.col("value").alias("loss"),
        payload.alias("k"),
    )


LOG = """log AS (SELECT user_id AS run, event_id AS pos, event_type AS phase, value AS loss,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""

TAIL = LOG + """,
chosen AS (SELECT run, CASE min(CASE phase WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 END)
  WHEN 1 THEN 'purchase' WHEN 2 THEN 'click' END AS sampled_phase FROM log GROUP BY run),
tail AS (SELECT * FROM (SELECT l.*, c.sampled_phase,
    row_number() OVER (PARTITION BY l.run ORDER BY l.pos DESC) AS rn
  FROM log l JOIN chosen c ON l.run = c.run
  WHERE c.sampled_phase IS NULL OR l.phase = c.sampled_phase) WHERE rn <= 10)"""

SUMMARY = TAIL + """,
means AS (SELECT run, count(*) AS sampled_rows, max(sampled_phase) AS sampled_phase,
    avg(loss) AS throughput_mean, avg(k) AS cpu_percent_mean, max(loss) AS gpu_reserved_max
  FROM tail GROUP BY run),
latest AS (SELECT run, max(pos) AS latest_step FROM log GROUP BY run),
facts AS (SELECT run, pos, loss, k, CASE phase WHEN 'error' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 END AS priority FROM log),
best AS (SELECT * FROM (SELECT run, priority, loss AS psnr, k AS ssim,
    row_number() OVER (PARTITION BY run ORDER BY priority, pos DESC) AS rn
  FROM facts WHERE priority IS NOT NULL) WHERE rn = 1),
summary AS (SELECT m.run, m.sampled_phase, m.sampled_rows, l.latest_step, b.priority AS source,
    m.throughput_mean, m.cpu_percent_mean, m.gpu_reserved_max, b.psnr, b.ssim
  FROM means m JOIN latest l ON m.run = l.run LEFT JOIN best b ON m.run = b.run)"""


def sources(rows: DataFrame) -> DataFrame:
    place = F.when(F.col("phase") == "error", 1).when(F.col("phase") == "signup", 2).when(F.col("phase") == "view", 3)
    facts = rows.withColumn("priority", place).where(F.col("priority").isNotNull())
    return runs.metric_source(facts, "run", F.col("priority"), F.col("pos"), ["loss", "k"])


def summary(spark: SparkSession, sf: str) -> DataFrame:
    """One row per run: tail means, best metric source, latest step."""
    rows = log(spark, sf)
    tail = runs.phase_tail(rows, "run", "phase", "pos", 10, PRIORITY)
    means = runs.tail_means(
        tail,
        "run",
        {"throughput_mean": F.col("loss"), "cpu_percent_mean": F.col("k")},
        {"gpu_reserved_max": F.col("loss")},
    )
    latest = rows.groupBy("run").agg(F.max("pos").alias("latest_step"))
    best = sources(rows).select(
        "run", F.col("priority").alias("source"), F.col("loss").alias("psnr"), F.col("k").alias("ssim")
    )
    return means.join(latest, "run").join(best, "run", "left")


@query("q_run_summary", f"""WITH {SUMMARY} SELECT run, sampled_phase, sampled_rows, latest_step, source,
  round(throughput_mean, 6) AS throughput_mean, round(cpu_percent_mean, 6) AS cpu_percent_mean,
  gpu_reserved_max, psnr, ssim FROM summary""")
def run_summary(spark, sf):
    return summary(spark, sf).select(
        "run", "sampled_phase", "sampled_rows", "latest_step", "source",
        F.round("throughput_mean", 6).alias("throughput_mean"),
        F.round("cpu_percent_mean", 6).alias("cpu_percent_mean"),
        "gpu_reserved_max", "psnr", "ssim",
    )


@query("q_log_scan", """SELECT user_id AS run, event_id AS pos, event_type AS phase,
  TRY_CAST(value AS DOUBLE) AS loss, CAST(trunc(value) AS BIGINT) AS whole FROM events""")
def log_scan(spark, sf):
    text = F.col("loss").cast("string")
    return log(spark, sf).select(
        "run", "pos", "phase", parsing.safe_float(text).alias("loss"), parsing.safe_int(text).alias("whole")
    )


@query("q_phase_tail", f"WITH {TAIL} SELECT run, pos, phase, loss, sampled_phase FROM tail")
def phase_tail(spark, sf):
    tail = runs.phase_tail(log(spark, sf), "run", "phase", "pos", 10, PRIORITY)
    return tail.select("run", "pos", "phase", "loss", "sampled_phase")


@query("q_latest_row", f"""WITH {LOG} SELECT run, pos, phase, loss, k FROM (SELECT *,
  row_number() OVER (PARTITION BY run ORDER BY pos DESC) AS rn FROM log) WHERE rn = 1""")
def latest_row(spark, sf):
    return runs.latest_row(log(spark, sf), "run", "pos")


@query("q_new_best", f"""WITH {LOG}, seen AS (SELECT run, pos, loss, coalesce(max(loss) OVER (PARTITION BY run ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best_before FROM log)
  SELECT run, pos, loss, best_before FROM seen WHERE loss > best_before""")
def new_best(spark, sf):
    return runs.new_bests(log(spark, sf).select("run", "pos", "loss"), "run", "pos", "loss")


@query("q_carry_forward", f"""WITH {LOG} SELECT run, pos, phase, last_value(CASE WHEN phase = 'purchase' THEN loss END IGNORE NULLS)
    OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS val_psnr FROM log""")
def carry_forward(spark, sf):
    known = F.when(F.col("phase") == "purchase", F.col("loss"))
    rows = log(spark, sf).select("run", "pos", "phase", "loss")
    return runs.carry_forward(rows, "run", "pos", {"val_psnr": known}).drop("loss")


@query("q_log_long", f"""WITH {LOG} SELECT run, pos, component, seconds FROM (
    SELECT run, pos, 'loss' AS component, loss AS seconds FROM log
    UNION ALL SELECT run, pos, 'k', k FROM log
    UNION ALL SELECT run, pos, 'phase', TRY_CAST(phase AS DOUBLE) FROM log) WHERE seconds IS NOT NULL""")
def log_long(spark, sf):
    return runs.long_numeric(log(spark, sf), ["run", "pos"], ["loss", "k", "phase"], "component", "seconds")


@query("q_log_sample", f"""WITH {LOG}, ends AS (SELECT run, max(pos) AS terminal FROM log GROUP BY run)
  SELECT l.run, l.pos, l.loss FROM log l JOIN ends e ON l.run = e.run
  WHERE l.pos <= 1 OR l.pos >= e.terminal OR l.pos % 10 = 0""")
def log_sample(spark, sf):
    rows = log(spark, sf)
    ends = rows.groupBy("run").agg(F.max("pos").alias("terminal"))
    return runs.logged_rows(ordered.join_facts(rows, ends, ["run"], ["pos"]), "pos", 10, F.col("terminal")).select("run", "pos", "loss")


@query("q_throughput", f"""WITH {LOG} SELECT run, pos, round(greatest(loss + k, 1e-8), 6) AS iter_time,
  round(loss / greatest(loss + k, 1e-8), 6) AS data_wait_ratio, round(16 / greatest(loss + k, 1e-8), 6) AS samples_per_sec FROM log""")
def throughput(spark, sf):
    shares = runs.throughput(F.col("loss"), F.col("k"), F.lit(8.0), processes=2)
    return log(spark, sf).select("run", "pos", *[F.round(expr, 6).alias(name) for name, expr in shares.items()])


@query("q_accumulate", f"""WITH {LOG}, micro AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY pos) - 1) // 4 AS update_step FROM log)
  SELECT run, update_step, round(sum(loss), 6) AS data_time, round(sum(k), 6) AS compute_time, count(*) AS micro_batches
  FROM micro GROUP BY run, update_step""")
def accumulate(spark, sf):
    sums = {"data_time": F.col("loss"), "compute_time": F.col("k")}
    updates = runs.accumulate(log(spark, sf).select("run", "pos", "loss", "k"), "run", "pos", 4, sums)
    return updates.withColumns({name: F.round(name, 6) for name in sums})


@query("q_run_delta", f"""WITH {LOG}, means AS (SELECT run, avg(loss) AS loss, avg(k) AS k FROM log GROUP BY run),
  base AS (SELECT loss AS bl, k AS bk FROM means WHERE run = (SELECT min(run) FROM means))
  SELECT run, round(loss - bl, 6) AS loss_delta, round(loss / nullif(bl, 0) - 1, 6) AS loss_ratio,
    round(k - bk, 6) AS k_delta, round(k / nullif(bk, 0) - 1, 6) AS k_ratio FROM means, base""")
def run_delta(spark, sf):
    means = log(spark, sf).groupBy("run").agg(F.avg("loss").alias("loss"), F.avg("k").alias("k"))
    baseline = means.agg(F.min_by("loss", "run").alias("loss"), F.min_by("k", "run").alias("k"))
    changed = runs.baseline_delta(means, baseline, ["loss", "k"])
    names = ["loss_delta", "loss_ratio", "k_delta", "k_ratio"]
    return changed.select("run", *[F.round(name, 6).alias(name) for name in names])


@query("q_stage", """SELECT CASE WHEN event_id < 300 THEN 'stage1_decom' WHEN event_id < 600 THEN 'stage2_adapter'
  ELSE 'stage3_joint' END AS stage, user_id AS run, count(*) AS n_rows FROM events GROUP BY 1, 2""")
def stage(spark, sf):
    from lumatable.functions.schedule import stage_label

    staged = log(spark, sf).withColumn("stage", stage_label(F.col("pos"), 300, 300))
    return staged.groupBy("stage", "run").agg(F.count(F.lit(1)).alias("n_rows"))


@query("q_job_outcome", f"""WITH {LOG} SELECT run, count(*) AS processed, count(*) FILTER (phase = 'error') AS failed,
  count(*) FILTER (phase <> 'error') AS succeeded, round(count(*) / greatest(sum(loss), 1e-8), 6) AS items_per_sec FROM log GROUP BY run""")
def job_outcome(spark, sf):
    outcome = runs.job_outcome(log(spark, sf), ["run"], F.col("phase") != "error", F.sum("loss"))
    return outcome.withColumn("items_per_sec", F.round("items_per_sec", 6))


@query("q_seconds_per_image", f"""WITH {LOG}, slow AS (SELECT run, pos // 64 AS batch, max(loss) AS elapsed, count(*) AS images FROM log GROUP BY 1, 2)
  SELECT run, round(sum(elapsed) / sum(images), 9) AS seconds_per_image FROM slow GROUP BY run""")
def seconds_per_image(spark, sf):
    timed = log(spark, sf).withColumn("batch", F.floor(F.col("pos") / 64))
    per_run = runs.seconds_per_image(timed, "run", "batch", "loss", F.count(F.lit(1)))
    return per_run.withColumn("seconds_per_image", F.round("seconds_per_image", 9))


@query("q_tail_lines", """SELECT run, pos, line FROM (SELECT user_id AS run, event_id AS pos, event_type || ' ' || props AS line,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 5""")
def tail_lines(spark, sf):
    lines = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("pos"), F.concat_ws(" ", "event_type", "props").alias("line")
    )
    return runs.tail_lines(lines, "run", "pos", 5)


def listing(spark, sf):
    """Folder listing: purchases stand for checkpoint folders, other events for unrelated names."""
    name = F.when(F.col("phase") == "purchase", F.format_string("checkpoint-%d", "pos")).otherwise(
        F.format_string("%s-%d", "phase", "pos")
    )
    return log(spark, sf).select("run", F.concat(F.format_string("out/%d/", "run"), name).alias("path"))


LISTING = """listing AS (SELECT user_id AS run, 'out/' || user_id || '/' || CASE WHEN event_type = 'purchase'
  THEN 'checkpoint-' || event_id ELSE event_type || '-' || event_id END AS path FROM events),
found AS (SELECT run, path, CAST(regexp_extract(path, '/checkpoint-([0-9]+)$', 1) AS BIGINT) AS step
  FROM listing WHERE regexp_matches(path, '/checkpoint-[0-9]+$'))"""


@query("q_checkpoints", f"""WITH {LISTING} SELECT run, max(step) AS step, arg_max(path, step) AS path,
  count(*) AS n_checkpoints FROM found GROUP BY run""")
def checkpoints(spark, sf):
    return runs.latest_checkpoint(runs.checkpoints(listing(spark, sf), "run", "path"), "run", "path")


@query("q_retention", f"""WITH {LISTING} SELECT run, path, step FROM (SELECT *,
  row_number() OVER (PARTITION BY run ORDER BY step DESC) AS rn FROM found) WHERE rn > 3""")
def retention(spark, sf):
    return runs.stale_checkpoints(runs.checkpoints(listing(spark, sf), "run", "path"), "run", 3)


@query("q_pick_step", """SELECT user_id AS run, CASE WHEN max(CASE WHEN event_id % 13 = 8 THEN 1 ELSE 0 END) = 1 THEN 8
  ELSE min(event_id % 13) END AS primary_step FROM events GROUP BY user_id""")
def pick_step(spark, sf):
    rows = log(spark, sf).withColumn("steps", F.col("pos") % 13)
    return runs.pick_step(rows, ["run"], "steps")


@query("q_metric_source", f"WITH {SUMMARY} SELECT run, priority, psnr AS loss, ssim AS k FROM best")
def metric_source(spark, sf):
    return sources(log(spark, sf))


@query("q_summary_lines", f"""WITH {SUMMARY} SELECT run, concat_ws(chr(10), '[' || run || ']',
  'sampled_phase: ' || coalesce(sampled_phase, '-'), 'sampled_rows: ' || sampled_rows, 'latest_step: ' || latest_step,
  'samples_per_sec_mean: ' || printf('%.3f', throughput_mean), 'cpu_percent_mean: ' || printf('%.1f', cpu_percent_mean),
  'psnr: ' || coalesce(printf('%.4f', psnr), '-'), 'lpips: -',
  'config_summary: config=' || sampled_phase || ' effective_batch=None') AS lines FROM summary""")
def summary_lines(spark, sf):
    fields = {
        "sampled_phase": (F.col("sampled_phase"), None),
        "sampled_rows": (F.col("sampled_rows"), None),
        "latest_step": (F.col("latest_step"), None),
        "samples_per_sec_mean": (F.col("throughput_mean"), 3),
        "cpu_percent_mean": (F.col("cpu_percent_mean"), 1),
        "psnr": (F.col("psnr"), 4),
        "lpips": (F.lit(None).cast("double"), 4),
    }
    text = runs.summary_text(F.col("run").cast("string"), fields)
    tail = runs.config_line({"config": F.col("sampled_phase"), "effective_batch": F.lit(None).cast("int")})
    return summary(spark, sf).select("run", F.concat_ws("\n", text, tail).alias("lines"))


@query("q_duration", f"""WITH {LOG}, t AS (SELECT run, pos, CAST(floor(loss * 60) AS BIGINT) AS s, k FROM log)
  SELECT run, pos, CASE WHEN s // 3600 > 0 THEN printf('%02d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60)
    ELSE printf('%02d:%02d', (s % 3600) // 60, s % 60) END AS elapsed,
  CASE WHEN k > 0 AND k < 80 THEN round(s / k * (80 - k), 6) END AS eta FROM t""")
def duration(spark, sf):
    seconds = F.floor(F.col("loss") * 60)
    eta = parsing.eta_seconds(seconds, F.col("k"), F.lit(80.0))
    return log(spark, sf).select(
        "run", "pos", parsing.duration_text(seconds).alias("elapsed"), F.round(eta, 6).alias("eta")
    )


@query("q_ema", f"""WITH {LOG} SELECT run, pos, round(list_reduce(list(loss) OVER (PARTITION BY run ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: 0.98::DOUBLE * a + (1 - 0.98::DOUBLE) * x), 6) AS ema FROM log""")
def ema(spark, sf):
    series = ordered.ema(log(spark, sf).select("run", "pos", "loss"), ["run"], "pos", {"ema": "loss"}, EMA_DECAY)
    return series.select("run", "pos", F.round("ema", 6).alias("ema"))


@query("q_ema_weights", f"""WITH {LOG}, prefix AS (SELECT run, pos, loss, k,
    row_number() OVER (PARTITION BY run ORDER BY pos) AS n,
    list(loss) OVER w AS xs, list(k) OVER w AS ks FROM log
    WINDOW w AS (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  emas AS (SELECT run, pos, n, loss, k,
    list_reduce(list_concat([greatest(xs[1], 1e-6::DOUBLE)], xs[2:]), lambda a, x: 0.98::DOUBLE * a + (1 - 0.98::DOUBLE) * x) AS e0,
    list_reduce(list_concat([greatest(ks[1], 1e-6::DOUBLE)], ks[2:]), lambda a, x: 0.98::DOUBLE * a + (1 - 0.98::DOUBLE) * x) AS e1 FROM prefix),
  w AS (SELECT *, least(4.0::DOUBLE, greatest(0.25::DOUBLE, greatest(e0, 1e-6) / greatest(e1, 1e-6))) AS w1 FROM emas)
  SELECT run, pos, round(w1, 6) AS weight, round(CASE WHEN n <= 5 THEN loss + k ELSE loss + w1 * k END, 6) AS total FROM w""")
def ema_weights(spark, sf):
    rows = log(spark, sf).select("run", "pos", "loss", "k")
    rows = ordered.numbered(rows, ["run"], "pos", "n")
    rows = ordered.ema(rows, ["run"], "pos", {"loss_ema": "loss", "k_ema": "k"}, EMA_DECAY, seed_floor=1e-6)
    ratio = F.greatest("loss_ema", F.lit(1e-6)) / F.greatest("k_ema", F.lit(1e-6))
    weight = F.least(F.lit(4.0), F.greatest(F.lit(0.25), ratio))
    plain = F.col("loss") + F.col("k")
    total = F.when(F.col("n") <= 5, plain).otherwise(F.col("loss") + weight * F.col("k"))
    return rows.select("run", "pos", F.round(weight, 6).alias("weight"), F.round(total, 6).alias("total"))


@query("q_status_json", """SELECT user_id AS run, event_id AS pos, CAST(json_extract_string(props, '$.k') AS BIGINT) AS step,
  TRY_CAST(json_extract_string(props, '$.val_psnr') AS DOUBLE) AS val_psnr FROM events""")
def status_json(spark, sf):
    # An absent key (val_psnr here) is null, as in a status file without a validation.
    parsed = F.from_json("props", "k string, val_psnr string")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        F.col("event_id").alias("pos"),
        parsing.safe_int(parsed["k"]).alias("step"),
        parsing.safe_float(parsed["val_psnr"]).alias("val_psnr"),
    )


def config_text() -> F.Column:
    """A resolved configuration made from an event."""
    return F.concat(
        F.lit('{"args":{"meta":{"name":"'), F.col("event_type"), F.lit('","k":1},"runtime":'), F.col("props"),
        F.lit(',"optimization":{"batch_size":'), F.col("user_id").cast("string"),
        F.lit(',"gradient_accumulation_steps":'), (F.col("event_id") % 5).cast("string"),
        F.lit('}},"config":"configs/train/'), F.col("event_type"), F.lit('.yaml"}'),
    )


SUMMARY_SQL = {
    "config_name": "event_type",
    "config_path": "'configs/train/' || event_type || '.yaml'",
    "batch_size": "CAST(user_id AS VARCHAR)",
    "gradient_accumulation_steps": "CAST(event_id % 5 AS VARCHAR)",
    "effective_batch_size": "greatest(1, user_id) * greatest(1, event_id % 5)",
    "benchmark_inference_steps": "'[]'",
}
SUMMARY = "summary AS (SELECT event_id AS pos, " + ", ".join(
    f"{SUMMARY_SQL.get(name, 'CAST(NULL AS VARCHAR)')} AS {name}" for name in config.SUMMARY_KEYS
) + " FROM events)"


def event_summary(spark, sf):
    events = table(spark, sf, "events").withColumn("text", config_text())
    outer = config.json_entries(F.col("text"))
    nested = config.json_entries(config.json_entries(outer["args"])["optimization"])
    args = F.map_concat(nested, F.create_map(F.lit("config"), outer["config"]))
    return config.runtime_summary(events.withColumn("args", args), "args", [F.col("event_id").alias("pos")])


@query("q_config_json", f"WITH {SUMMARY} SELECT *, '{'|'.join(config.PRECEDENCE_TEXT)}' AS config_precedence FROM summary")
def config_json(spark, sf):
    return event_summary(spark, sf).withColumn("config_precedence", F.array_join("config_precedence", "|"))


def line_sql(line) -> str:
    parts = [f"'{text}'" + (f" || coalesce(CAST({name} AS VARCHAR), 'None')" if name else "") for text, name in line]
    return f"'{config.LINE_PREFIX}' || " + " || ".join(parts)


@query("q_config_lines", f"WITH {SUMMARY} " + " UNION ALL ".join(
    f"SELECT pos, {at} AS at, {line_sql(line)} AS line FROM summary" for at, line in enumerate(config.SUMMARY_LINES)
))
def config_lines(spark, sf):
    return config.summary_text(event_summary(spark, sf), ["pos"])


@query("q_config_write", f"""WITH {LOG} SELECT run, pos, CAST(json_object('phase', phase, 'step', pos, 'loss_cents', CAST(round(loss * 100) AS BIGINT), 'val_psnr', NULL) AS VARCHAR) AS payload FROM log""")
def config_write(spark, sf):
    """A status snapshot per log row as JSON."""
    fields = log(spark, sf).withColumns(
        {"step": F.col("pos"), "loss_cents": F.round(F.col("loss") * 100).cast("bigint"), "val_psnr": F.lit(None).cast("double")}
    )
    payload = config.record_json(["phase", "step", "loss_cents", "val_psnr"])
    return fields.select("run", "pos", payload.alias("payload"))


@query("q_flatten", """SELECT event_id AS pos, key, value FROM (
    SELECT event_id, 'name' AS key, event_type AS value FROM events
    UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events
    UNION ALL SELECT event_id, 'batch_size', CAST(user_id AS VARCHAR) FROM events
    UNION ALL SELECT event_id, 'gradient_accumulation_steps', CAST(event_id % 5 AS VARCHAR) FROM events
    UNION ALL SELECT event_id, 'config', 'configs/train/' || event_type || '.yaml' FROM events)""")
def flatten(spark, sf):
    events = table(spark, sf, "events").select(F.col("event_id").alias("pos"), config_text().alias("text"))
    return config.flatten_json(events, "pos", "text")


@query("q_flatten_deep", """SELECT event_id AS pos, key, value FROM (
    SELECT event_id, 'user' AS key, CAST(user_id AS VARCHAR) AS value FROM events
    UNION ALL SELECT event_id, 'k', json_extract_string(props, '$.k') FROM events
    UNION ALL SELECT event_id, 'name', CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'outer' END FROM events
    UNION ALL SELECT event_id, 'leaf', CAST(event_id % 7 AS VARCHAR) FROM events)""")
def flatten_deep(spark, sf):
    """Six levels; in every other event the name is replaced by a later branch nearer to the root."""
    deep = F.concat(
        F.lit('{"a":{"b":{"c":{"d":{"name":"'), F.col("event_type"), F.lit('","e":{"leaf":'), (F.col("event_id") % 7).cast("string"),
        F.lit('}},"user":'), F.col("user_id").cast("string"), F.lit("}},\"z\":"), F.col("props"), F.lit("}"),
        F.when(F.col("event_id") % 2 == 0, F.lit("}")).otherwise(F.lit(',"name":"outer"}')),
    )
    return config.flatten_json(table(spark, sf, "events").select(F.col("event_id").alias("pos"), deep.alias("text")), "pos", "text")


LAYERS = """layers AS (SELECT c_nationkey AS run, c_custkey AS pos, 'key' || (c_custkey % 7) AS key,
  CASE c_custkey % 4 WHEN 0 THEN 'yaml' WHEN 1 THEN 'builtin' WHEN 2 THEN 'launch' ELSE 'cli' END AS layer,
  CASE WHEN c_acctbal >= 0 AND c_custkey % 3 > 0 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) END AS value FROM customer)"""


@query("q_config_merge", f"""WITH {LAYERS} SELECT run, key, layer, value FROM (SELECT *, row_number() OVER (PARTITION BY run, key
  ORDER BY CASE layer WHEN 'cli' THEN 1 WHEN 'launch' THEN 2 WHEN 'yaml' THEN 3 ELSE 4 END, pos DESC) AS rn
  FROM layers WHERE value IS NOT NULL) WHERE rn = 1""")
def config_merge(spark, sf):
    kind = F.element_at(parsing.strings(["yaml", "builtin", "launch", "cli"]), (F.col("c_custkey") % 4 + 1).cast("int"))
    known = (F.col("c_acctbal") >= 0) & (F.col("c_custkey") % 3 > 0)
    layers = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("run"),
        F.col("c_custkey").alias("pos"),
        F.format_string("key%d", F.col("c_custkey") % 7).alias("key"),
        kind.alias("layer"),
        F.when(known, F.floor("c_acctbal").cast("string")).alias("value"),
    )
    return config.merge_layers(layers, "run", "layer", "key", "value", "pos")


@query("q_preset_summary", """WITH preset AS (SELECT c_nationkey AS id, count(*) % 7 AS batch, max(c_custkey) % 5 AS accumulation FROM customer GROUP BY 1)
  SELECT n_name AS name, 'configs/train/' || n_name || '.yaml' AS config_path, batch AS batch_size, accumulation AS gradient_accumulation_steps,
    greatest(1, batch) * greatest(1, accumulation) AS effective_batch,
    CASE WHEN greatest(1, batch) * greatest(1, accumulation) < 16 THEN 1 ELSE 0 END AS below_minimum
  FROM preset JOIN nation ON id = n_nationkey""")
def preset_summary(spark, sf):
    sizes = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        (F.count(F.lit(1)) % 7).alias("batch_size"), (F.max("c_custkey") % 5).alias("gradient_accumulation_steps")
    )
    presets = sizes.join(table(spark, sf, "nation"), "n_nationkey")
    total = config.effective_batch(F.col("batch_size"), F.col("gradient_accumulation_steps"))
    return presets.select(
        F.col("n_name").alias("name"),
        F.concat(F.lit("configs/train/"), "n_name", F.lit(".yaml")).alias("config_path"),
        "batch_size",
        "gradient_accumulation_steps",
        total.alias("effective_batch"),
        (total < runs.MIN_EFFECTIVE_BATCH).cast("int").alias("below_minimum"),
    )


REQUEST = """asked AS (SELECT p_partkey, p_size, ['lpips', 'psnr', 'NIQE', 'unknown', 'semantic_distance'] AS names FROM part),
request AS (SELECT p_partkey, p_size, names[1 + p_size % 5] || ', ' || names[1 + p_partkey % 5] || ' ' || names[1 + (p_size + 2) % 5] AS text FROM asked)"""


def request(spark, sf):
    names = parsing.strings(["lpips", "psnr", "NIQE", "unknown", "semantic_distance"])

    def pick(index):
        return F.element_at(names, (index % 5 + 1).cast("int"))

    size, part = F.col("p_size"), F.col("p_partkey")
    text = F.concat(pick(size), F.lit(", "), pick(part), F.lit(" "), pick(size + 2))
    return table(spark, sf, "part").select("p_partkey", "p_size", text.alias("text"))


@query("q_ordered_dedupe", f"""WITH {REQUEST}, items AS (SELECT p_partkey, p_size, list_filter(
    list_transform(string_split_regex(replace(text, ',', ' '), '\\s+'), lambda x: lower(x)),
    lambda x: x IN ('psnr', 'ssim', 'lpips', 'semantic_distance', 'niqe')) AS wanted FROM request),
  steps AS (SELECT p_partkey, wanted, [p_size % 9 - 2, p_partkey % 4, p_size % 9 - 2, 8] AS counts FROM items)
  SELECT p_partkey, (SELECT string_agg(m, ',' ORDER BY first_at) FROM (SELECT m, min(i) AS first_at FROM (
      SELECT unnest(list_concat(['psnr', 'ssim'], wanted)) AS m, generate_subscripts(list_concat(['psnr', 'ssim'], wanted), 1) AS i) GROUP BY m)) AS metrics,
    (SELECT string_agg(CAST(s AS VARCHAR), ',' ORDER BY first_at) FROM (SELECT s, min(i) AS first_at FROM (
      SELECT unnest(counts) AS s, generate_subscripts(counts, 1) AS i) WHERE s > 0 GROUP BY s)) AS step_counts FROM steps""")
def ordered_dedupe(spark, sf):
    size = (F.col("p_size") % 9 - 2).cast("int")
    counts = parsing.step_counts(F.array(size, (F.col("p_partkey") % 4).cast("int"), size), F.lit(8))
    return request(spark, sf).select(
        "p_partkey",
        F.array_join(parsing.metric_names(parsing.list_items(F.col("text"))), ",").alias("metrics"),
        F.array_join(counts.cast("array<string>"), ",").alias("step_counts"),
    )


@query("q_validation_plan", f"""WITH {REQUEST}, r AS (SELECT p_partkey, p_size % 2 = 0 AS fast, list_distinct(list_filter(
    list_transform(string_split_regex(replace(text, ',', ' '), '\\s+'), lambda x: lower(x)), lambda x: x IN ('lpips', 'semantic_distance', 'niqe'))) AS wanted,
    p_size % 9 - 2 AS a, p_partkey % 4 AS b FROM request),
  names AS (SELECT p_partkey, fast, a, b, unnest(CASE WHEN fast THEN list_concat(['psnr', 'ssim'], wanted) ELSE ['psnr', 'ssim', 'lpips', 'semantic_distance', 'niqe'] END) AS metric FROM r),
  steps AS (SELECT p_partkey, metric, fast, unnest(list_distinct(list_filter(CASE WHEN fast THEN [b, 8] ELSE [a, b, 8] END, lambda x: x > 0))) AS step_count FROM names)
  SELECT p_partkey, step_count, metric, fast FROM steps""")
def validation_plan(spark, sf):
    """Every request as the metrics it asks for at each of its step counts; fast ones ask for less."""
    size, part = (F.col("p_size") % 9 - 2).cast("int"), (F.col("p_partkey") % 4).cast("int")
    asked = request(spark, sf).select(
        "p_partkey", (F.col("p_size") % 2 == 0).alias("fast"), parsing.list_items(F.col("text")).alias("metrics"),
        F.array(part).alias("fast_steps"), F.array(size, part).alias("steps"),
    )
    return runs.validation_plan(asked, F.lit(8)).select("p_partkey", "step_count", "metric", "fast")


@query("q_norm_list", f"""WITH {REQUEST}, norm AS (SELECT p_partkey, list_filter(string_split_regex(replace(text, ',', ' '), '\\s+'), lambda x: x <> '') AS items,
    CASE p_size % 5 WHEN 0 THEN 'mini_snr' WHEN 1 THEN ' P2' WHEN 2 THEN 'EDM' WHEN 3 THEN 'min_snr' ELSE 'other' END AS scheme FROM request)
  SELECT p_partkey, array_to_string(items, '|') AS items, len(items) AS n_items,
    CASE lower(trim(scheme)) WHEN 'mini_snr' THEN 'min_snr' WHEN 'other' THEN NULL ELSE lower(trim(scheme)) END AS scheme FROM norm""")
def norm_list(spark, sf):
    schemes = parsing.strings(["mini_snr", " P2", "EDM", "min_snr", "other"])
    scheme = F.element_at(schemes, (F.col("p_size") % 5 + 1).cast("int"))
    items = parsing.list_items(F.col("text"))
    return request(spark, sf).select(
        "p_partkey",
        F.array_join(items, "|").alias("items"),
        F.size(items).alias("n_items"),
        parsing.weighting_scheme(scheme).alias("scheme"),
    )


@query("q_safe_parse", """WITH t AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN ' 8.0 ' WHEN 3 THEN '-8.7'
    WHEN 4 THEN 'Customer' WHEN 5 THEN '1e3' ELSE CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) END AS text FROM customer)
  SELECT c_custkey, TRY_CAST(trim(text) AS DOUBLE) AS as_float, CAST(trunc(TRY_CAST(trim(text) AS DOUBLE)) AS BIGINT) AS as_int FROM t""")
def safe_parse(spark, sf):
    kinds = parsing.strings(["", "None", " 8.0 ", "-8.7", "Customer", "1e3"])
    balance = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    text = F.coalesce(F.get(kinds, (F.col("c_custkey") % 7).cast("int")), balance)
    return table(spark, sf, "customer").select(
        "c_custkey", parsing.safe_float(text).alias("as_float"), parsing.safe_int(text).alias("as_int")
    )


def report_rows(spark, sf):
    """Conversations as reports: a user turn is a section header, other turns hold metrics."""
    turn, size = F.col("turn"), F.length("text")
    metrics = F.array(
        F.concat(F.lit("PSNR: "), size.cast("string")),
        F.concat(F.lit(" SSIM :  "), (size % 97).cast("string"), F.lit(".5 ")),
        F.concat(F.lit("LPIPS: "), F.when(size % 3 == 0, "None").otherwise((size % 11).cast("string"))),
        F.when(turn % 2 == 1, F.concat(F.lit("Step: "), F.when(size % 5 == 0, "None").otherwise(size.cast("string")))),
        F.lit("no number here"),
    )
    header = F.array(F.concat(F.lit("[steps="), (turn % 3 * 4 + 4).cast("string"), F.lit("]")))
    lines = F.when(F.col("role") == "user", header).otherwise(metrics)
    return (
        table(spark, sf, "conversations")
        .select("conv_id", "turn", F.posexplode(lines).alias("_i", "_raw"))
        .where(F.col("_raw").isNotNull())
        .select("conv_id", (F.col("turn") * 10 + F.col("_i")).alias("pos"), parsing.stripped(F.col("_raw")).alias("line"))
    )


REPORT = """lines AS (
  SELECT conv_id, turn * 10 AS pos, turn % 3 * 4 + 4 AS steps, NULL AS key, NULL AS value FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn * 10, NULL, 'psnr', length(text)::DOUBLE FROM conversations WHERE role <> 'user'
  UNION ALL SELECT conv_id, turn * 10 + 1, NULL, 'ssim', (length(text) % 97)::DOUBLE + 0.5 FROM conversations WHERE role <> 'user'
  UNION ALL SELECT conv_id, turn * 10 + 2, NULL, 'lpips', CASE WHEN length(text) % 3 = 0 THEN NULL ELSE (length(text) % 11)::DOUBLE END
    FROM conversations WHERE role <> 'user'),
filled AS (SELECT *, last_value(steps IGNORE NULLS) OVER w AS step_count,
    last_value(CASE WHEN steps IS NOT NULL THEN pos END IGNORE NULLS) OVER w AS section FROM lines
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
final AS (SELECT conv_id, steps AS step_count, max(pos) AS section FROM lines WHERE steps IS NOT NULL GROUP BY 1, 2),
parsed AS (SELECT f.conv_id, f.step_count, f.key AS metric, arg_max(f.value, f.pos) AS value FROM filled f JOIN final l
    ON f.conv_id = l.conv_id AND f.step_count = l.step_count AND f.section = l.section
  WHERE f.steps IS NULL AND f.value IS NOT NULL GROUP BY 1, 2, 3)"""


@query("q_report_parse", f"WITH {REPORT} SELECT conv_id, step_count, metric, value FROM parsed")
def report_parse(spark, sf):
    return runs.parse_report(report_rows(spark, sf), "conv_id")


@query("q_report_cards", f"""WITH {REPORT} SELECT conv_id, upper(key) AS card, arg_max(value, pos) AS value FROM lines
  WHERE key IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2""")
def report_cards(spark, sf):
    return runs.parse_report_cards(report_rows(spark, sf), "conv_id")


@query("q_report_step", """SELECT conv_id, arg_max_null(CASE WHEN length(text) % 5 = 0 THEN NULL ELSE length(text) END, turn) AS train_step
  FROM conversations WHERE role <> 'user' AND turn % 2 = 1 GROUP BY conv_id""")
def report_step(spark, sf):
    return runs.report_step(report_rows(spark, sf), "conv_id")


@query("q_report_write", f"""WITH {REPORT}, wide AS (SELECT conv_id, step_count, max(value) FILTER (metric = 'psnr') AS psnr,
    max(value) FILTER (metric = 'ssim') AS ssim, max(value) FILTER (metric = 'lpips') AS lpips FROM parsed GROUP BY 1, 2),
  sections AS (SELECT conv_id, step_count, concat_ws(chr(10), '[steps=' || step_count || ']', printf('PSNR: %.4f', psnr),
    printf('SSIM: %.4f', ssim), printf('SecondsPerImage: %.6f', psnr / 64), printf('LPIPS: %.4f', lpips)) AS section FROM wide)
  SELECT conv_id, string_agg(section, chr(10) || chr(10) ORDER BY step_count) || chr(10) || 'Step: ' || max(step_count) || chr(10) AS report
  FROM sections GROUP BY conv_id""")
def report_write(spark, sf):
    parsed = runs.parse_report(report_rows(spark, sf), "conv_id")
    wide = parsed.groupBy("conv_id", "step_count").pivot("metric", ["psnr", "ssim", "lpips"]).agg(F.max("value"))
    metrics = {
        "psnr": F.col("psnr"),
        "ssim": F.col("ssim"),
        "seconds_per_image": F.col("psnr") / 64,
        "lpips": F.col("lpips"),
    }
    sections = wide.select("conv_id", "step_count", runs.section_text(F.col("step_count"), metrics).alias("section"))
    return runs.report_text(sections, "conv_id", "step_count", "section", F.col("step_count"))
