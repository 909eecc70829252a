"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatable.llm.common import content, materialize, with_global_rank


def interleave(df: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """Deal rows into shards so that each holds the same mixture of sources; row counts differ by one at most.

    Rows are shuffled by a seeded hash and ranked inside their source; the row of rank r of n gets
    the fractional rank (r + 0.5) / n. Sorted by it, every stretch of the table holds each source
    in proportion, so equal stretches are the shards. Ranks come from range sorts and partition
    counts, so a source with most rows is spread over all tasks; texts are never shuffled.

    Null sources are one stratum; a null text has size 1 and checksum 0; rows that repeat get
    places of their own; an empty table gives no rows; other columns are ignored.
    """
    text = content()
    rows = materialize(
        df.select(
            "doc_id",
            "source",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(F.lit(seed), F.col("doc_id"), text).alias("draw"),
        ),
        "shard-rows",
    )
    order = [F.col("source"), F.col("draw"), F.col("doc_id"), F.col("text_crc32")]
    ranked = with_global_rank(rows, order, "rank", "shard-source")
    strata = ranked.groupBy(F.col("source").alias("stratum")).agg(
        F.min("rank").alias("first"), F.count("*").alias("n")
    )
    # No hint: Spark broadcasts the strata if they are small and splits a hot source otherwise.
    shares = ranked.join(strata, F.col("source").eqNullSafe(F.col("stratum"))).select(
        "doc_id", "size", "text_crc32", "draw", ((F.col("rank") - F.col("first") + 0.5) / F.col("n")).alias("share")
    )
    dealt = with_global_rank(shares, [F.col("share"), F.col("draw"), F.col("doc_id")], "place", "shard-share")
    total = rows.count()
    shard = F.expr(f"(place * {shards}) div {max(total, 1)}")
    return dealt.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"place - (shard * {total} + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
