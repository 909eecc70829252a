"""Mixing sources to target weights: random order inside each source, prefix sums, exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumatable.llm.common import LOCAL_BITS, content, materialize, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
SEED = 23


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """Random place of a row: the first 60 bits of a digest of seed, id and text. Equal in every run."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text)
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def with_prefix_sums(df: DataFrame, by: list[Column], sums: dict[str, str], label: str) -> DataFrame:
    """`df` with the sum of columns over all rows before each in the order `by` (from 0).

    A range sort written once; inside a partition a running sum, before it one total per partition.
    No task sees more than its range, however many rows are equal in the first keys.
    """
    placed = materialize(
        df.repartitionByRange(shuffle_partitions(df.sparkSession), *by)
        .sortWithinPartitions(*by)
        .withColumn("_at", F.monotonically_increasing_id()),
        label,
    )
    placed = placed.withColumn("_part", F.shiftrightunsigned("_at", LOCAL_BITS))
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])
    # One row per partition, so this window is small whatever the table's size.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_start_{name}") for name in sums])
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    within = placed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_in_{name}") for name, c in sums.items()])
    added = {name: F.col(f"_start_{name}") + F.col(f"_in_{name}") for name in sums}
    joined = within.join(F.broadcast(starts), "_part").withColumns(added)
    return joined.drop("_part", "_at", *[f"_start_{name}" for name in sums], *[f"_in_{name}" for name in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, first, target) of a table (source, source_size) with one row per source.

    Sources in code-point order, null last, weigh `weights` in turn. All sizes together are shared by
    weight; a target stops at `most` times its source, and the excess goes to the others by weight. The
    others then get weight x level for one level. Sorted by the weight each source could carry per unit,
    the stopped ones come first, so the level is the largest quotient (what is left) / (weights left)
    that does not exceed the next source's limit. `first` is the sum of the sources before it.
    """
    ordered = with_prefix_sums(
        sizes.select("source", "source_size", F.lit(1).alias("_one")),
        [F.col("source").isNull(), F.col("source")],
        {"first": "source_size", "_rank": "_one"},
        "mix-sources",
    )
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = materialize(
        ordered.select("source", "source_size", "first", turn.alias("_weight"), (most * F.col("source_size")).alias("_limit")), "mix-weights"
    )
    whole = weighed.agg(F.sum("source_size").alias("total"), F.sum("_weight").alias("weight")).first()
    total, weight = whole["total"] or 0, whole["weight"] or 0
    ratio = F.col("_limit") / F.col("_weight")
    stopped = with_prefix_sums(
        weighed.select("source", "_weight", "_limit", ratio.alias("_ratio")), [F.col("_ratio"), F.col("source")],
        {"_gone": "_limit", "_used": "_weight"}, "mix-levels",
    )
    levels = stopped.select((((F.lit(total) - F.col("_gone"))) / (F.lit(weight) - F.col("_used"))).alias("level"), "_ratio")
    level = levels.where(F.col("level") <= F.col("_ratio")).agg(F.max("level")).first()[0] or 0.0
    target = F.least(F.col("_weight") * F.lit(float(level)), F.col("_limit").cast("double"))
    return weighed.select("source", "source_size", "first", target.alias("target"))


def plan_mixture(
    df: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = SEED
) -> DataFrame:
    """How often each row is taken: doc_id, size, source_size, target, epochs, part.

    A source's budget is its target rounded to whole words. The budget holds the source so many times
    (epochs); the rest is cut from the rows in their random order: a row before the cut is taken once
    more, the row on the cut with its first `part` words. So sources take their budgets exactly.

    Rows are sorted by source and draw with one range sort of compact rows, so a source with most rows
    is spread over all tasks; texts are never shuffled. A null text has size 0; null sources are one
    source; repeated rows have places of their own; an empty table gives no rows; other columns are
    ignored.
    """
    text = content()
    rows = materialize(
        df.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            draw(seed, F.col("doc_id"), text).alias("_draw"),
        ),
        "mix-rows",
    )
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = targets(per_source, weights, most).withColumnRenamed("source", "_source")
    order = [F.col("source").isNull(), F.col("source"), F.col("_draw"), F.col("doc_id"), F.col("size")]
    summed = with_prefix_sums(rows, order, {"_before": "size"}, "mix-order")
    # No hint: Spark broadcasts the sources if they are small and splits a hot one otherwise.
    joined = summed.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    taken = joined.withColumn("_budget", budget).withColumn("epochs", F.expr("coalesce(_budget div nullif(source_size, 0), 0L)"))
    left = F.col("_budget") - F.col("epochs") * F.col("source_size") - (F.col("_before") - F.col("first"))
    part = F.greatest(F.lit(0), F.least(left, F.col("size"))).cast("long")
    return taken.select("doc_id", "source", "size", "source_size", "target", "epochs", part.alias("part"), "_draw")


def mix_sizes(df: DataFrame) -> DataFrame:
    """The plan's sizes, targets and taken words per row of `documents`."""
    return plan_mixture(df).select(
        "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken")
    )


def mixed_rows(df: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixture itself: the rows of `df`, each as often as the plan takes it, with the column `epoch`.

    A row that the plan takes in part comes last in its source with the text up to its last word. The
    plan has one cut per source, so texts are not shuffled: every row compares its draw with the cut.
    """
    cut = plan.where("part < size and part > 0").groupBy("source").agg(
        F.min_by(F.struct("_draw", "doc_id", "size", "part"), F.struct("_draw", "doc_id", "size")).alias("_cut")
    )
    beyond = F.struct("_draw", "doc_id", "size")
    last = plan.where("part > 0 and part = size").groupBy("source").agg(F.max(beyond).alias("_last"))
    epochs = plan.groupBy("source").agg(F.max("epochs").alias("_epochs"))
    ways = epochs.alias("e")
    for name, other in (("_cut", cut), ("_last", last)):
        other = other.withColumnRenamed("source", "_s")
        ways = ways.join(other, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    ways = ways.withColumnRenamed("source", "_source")
    text = content()
    drawn = df.withColumn("_size", F.regexp_count(text, F.lit(WORD)).cast("long")).withColumn("_place", draw(seed, F.col("doc_id"), text))
    place = F.struct(F.col("_place").alias("_draw"), "doc_id", F.col("_size").alias("size"))
    joined = drawn.join(ways, F.col("source").cast("string").eqNullSafe(F.col("_source")))
    on_cut = place.eqNullSafe(F.struct("_cut._draw", "_cut.doc_id", "_cut.size"))
    extra = F.when(on_cut & F.col("_cut").isNotNull(), F.col("_cut.part")).when(place <= F.col("_last"), F.col("_size")).otherwise(F.lit(0))
    copies = F.expr(
        "concat(transform(if(_epochs > 0, sequence(1, _epochs), cast(array() as array<bigint>)), e -> struct(e as epoch, _size as words)),"
        " if(_extra > 0, array(struct(_epochs + 1 as epoch, _extra as words)), cast(array() as array<struct<epoch:bigint,words:bigint>>)))"
    )
    shown = joined.withColumn("_extra", extra.cast("long")).withColumn("_copy", F.explode(copies))
    pieces = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    first_words = F.array_join(F.slice(pieces, 1, F.col("_copy.words").cast("int")), "")
    cut_text = F.when(F.col("_copy.words") < F.col("_size"), first_words).otherwise(F.col("text"))
    return shown.select(*[cut_text.alias("text") if c == "text" else F.col(c) for c in df.columns], F.col("_copy.epoch").alias("epoch"))


ORACLE_SQL = rf"""
WITH drawn AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS draw
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM drawn GROUP BY source),
totals AS (SELECT sum(source_size) AS total, sum(weight) AS weights FROM sources),
levels AS (
  SELECT 3 * source_size / weight AS ratio,
    CAST(total - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE) / CAST(weights - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS level
  FROM sources, totals
  WINDOW before AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (
  SELECT source, source_size, least(weight * (SELECT max(level) FROM levels WHERE level <= ratio), CAST(3 * source_size AS DOUBLE)) AS target
  FROM sources),
ordered AS (
  SELECT d.*, a.source_size, a.target, CAST(floor(a.target + 0.5) AS BIGINT) AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM drawn d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE
    (budget // source_size) * size + greatest(0, least(budget % source_size - before, size)) END AS taken
FROM ordered
"""
