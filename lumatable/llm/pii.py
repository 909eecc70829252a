"""Personal data: fixed patterns, and identifiers found through the contexts of those they match.

DataFrame functions only. Base matches are the seeds; the words before them are patterns; a graph of
patterns and identifier-like tokens is scored in rounds; tokens that trusted patterns point to are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumatable.llm.common import content, materialize, row_key

KINDS = ("email", "ip", "card", "phone")
TOKEN = "token"
# The fixed patterns in a form that Java's engine matches in linear time and without recursion: possessive
# runs, and starts only where a longer match could not have begun before (or where the last match ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # A run without white space that holds a digit or an at sign: what may be an identifier.
    TOKEN: r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"  # at most 255
ROUNDS = 3
SEEDS = 3.0  # least sum of scores behind a pattern
PRIOR = 1.0
# Least share of a kind's known identifiers among the tokens behind a pattern that have this kind's shape. Where the
# fixed patterns know half of a kind's written forms, a share t means that 2t are identifiers, and t / (1 - t) of the
# tokens added: three quarters at 3/7. They know less of phones (only international ones), so more are right there.
TRUST = 3 / 7


def _last_words(gap: Column) -> Column:
    """The last two words, digits as zeros, whole however long they are."""
    words = F.filter(F.split(F.lower(F.regexp_replace(gap, "[0-9]", "0")), r"\s+"), lambda w: w != "")
    return F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2))


def _matches(text: Column, kind: str) -> Column:
    """Row-local: array of struct(kind, i, gap, value, before) of the kind's matches in order.

    `gap` is the number of code points since the match before, `before` their last two words.
    """
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    needed = F.contains(text, F.lit("@")) if kind == "email" else text.rlike("[0-9@]" if kind == TOKEN else "[0-9]")
    rows = F.transform(
        F.arrays_zip(found.alias("value"), gaps.alias("gap")),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(x["gap"]).cast("long").alias("gap"),
            x["value"].alias("value"),
            (_last_words(x["gap"]) if kind == TOKEN else F.array().cast("array<string>")).alias("before"),
        ),
    )
    return F.when(needed, F.filter(rows, lambda x: x["value"].isNotNull()))


def _doubled(digit: Column, second: Column) -> Column:
    return F.when(second, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    worth = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))),
        lambda i: _doubled(F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48, i % 2 == 0),
    )
    return F.aggregate(worth, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"))
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def _shaped(kind: Column, value: Column) -> Column:
    """Whether a token may be an identifier of the kind at all."""
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(kind == "email", F.contains(value, F.lit("@")))
        .when(kind == "ip", value.rlike("^[0-9a-fA-F]+(?:[.:][0-9a-fA-F]+){3,7}$"))
        .when(kind == "card", n.between(12, 19))
        .otherwise(n.between(7, 15))
    )


def _located(df: DataFrame) -> DataFrame:
    """(doc_id, key, copies, kind, value, before, start, end): valid matches and tokens with their places.

    Documents without any keep a row of nulls; documents with equal id and text are one, with a count.
    """
    rows = df.select(F.col("doc_id").cast("long"), row_key().alias("key"), content().alias("text"))
    found = F.concat(*[F.coalesce(_matches(F.col("text"), k), F.array()) for k in (*KINDS, TOKEN)])
    flat = rows.select("doc_id", "key", F.explode_outer(found).alias("m")).select("doc_id", "key", "m.*")
    once = flat.groupBy("doc_id", "key", "kind", "i").agg(
        F.first("gap").alias("gap"), F.first("value").alias("value"), F.first("before").alias("before"), F.count("*").alias("copies")
    )
    along = Window.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = once.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(along))
    placed = placed.withColumn("start", F.col("end") - F.length("value"))
    ok = F.col("kind").isNull() | _valid(F.col("kind"), F.col("value"))
    # A document must keep a row when none of its matches is valid.
    return placed.select(
        "doc_id", "key", "copies", *[F.when(ok, F.col(c)).alias(c) for c in ("kind", "value", "before", "start", "end")]
    )


def _tokens(located: DataFrame) -> DataFrame:
    """Identifier-like tokens with their context and, where a base match starts in them, its kind."""
    base = F.col("kind") != TOKEN
    rows = located.where(F.col("kind").isNotNull())
    key = ["doc_id", "key"]
    ahead = Window.partitionBy(*key).orderBy("start", F.when(base, 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    back = Window.partitionBy(*key).orderBy(F.desc("start"), F.when(base, 0).otherwise(1)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = rows.withColumn("covered", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn(
        "next", F.last(F.when(base, F.struct("start", "kind", "value")), ignorenulls=True).over(back)
    )
    rows = rows.where(~base & (F.coalesce(F.col("covered"), F.lit(0)) <= F.col("start")))
    lead = F.length(F.regexp_extract("value", r"^[^0-9A-Za-z+(]*", 0))
    bare = F.regexp_replace(F.regexp_replace("value", r"^[^0-9A-Za-z+(]+", ""), r"[^0-9A-Za-z)]+$", "")
    seeded = F.col("next.start") < F.col("end")
    return rows.select(
        *key,
        F.when(seeded, F.col("next.kind")).alias("seed"),
        F.when(seeded, F.col("next.value")).otherwise(bare).alias("value"),
        (F.col("start") + lead).alias("start"),
        (F.col("start") + lead + F.length(bare)).alias("end"),
        F.array_join("before", " ").alias("two"),
        F.coalesce(F.try_element_at("before", F.lit(-1)), F.lit("")).alias("one"),
    )


def _trusted_values(tokens: DataFrame, rounds: int) -> DataFrame | None:
    """(value, kind) of tokens, matched by no fixed pattern, that trusted patterns point to."""
    shapes = F.array_compact(F.array(*[F.when(_shaped(F.lit(k), F.col("value")), F.lit(k)) for k in KINDS]))
    # Tokens that can be no identifier, such as years and counts, say nothing about a pattern.
    tokens = tokens.withColumn("shapes", shapes).where(F.col("seed").isNotNull() | (F.size("shapes") > 0))
    # A run of card length whose check digit is wrong speaks against a pattern, but is no card itself.
    luhn = F.when(F.array_contains("shapes", "card"), _luhn(F.regexp_replace("value", "[^0-9]", ""))).otherwise(True)
    tokens = tokens.withColumn("may", F.when(luhn, F.col("shapes")).otherwise(F.array_remove("shapes", "card")))
    by_two = tokens.select("value", "seed", "shapes", "may", F.concat(F.lit("2 "), F.col("two")).alias("pattern"))
    by_one = tokens.select("value", "seed", "shapes", "may", F.concat(F.lit("1 "), F.col("one")).alias("pattern"))
    edges = materialize(by_two.union(by_one).distinct(), "pii-edges")
    trusted = None
    for _ in range(rounds):
        known = edges.withColumn("score", F.when(F.col("seed").isNotNull(), 1.0))
        if trusted is not None:
            more = trusted.select("value", F.col("kind").alias("found"), F.col("score").alias("found_score"))
            known = known.join(more, "value", "left").select(
                "value", "pattern", "shapes", F.coalesce("seed", "found").alias("seed"), F.coalesce("score", "found_score").alias("score")
            )
        sums = [F.coalesce(F.sum(F.when(F.col("seed") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in KINDS]
        like = [F.count_if((F.col("seed").eqNullSafe(k)) | F.array_contains("shapes", k)).alias(f"n_{k}") for k in KINDS]
        patterns = known.groupBy("pattern").agg(*sums, *like)
        # A pattern may introduce several kinds: each has a trust of its own.
        ranked = F.array(
            *[
                F.struct(F.lit(k).alias("kind"), F.col(k).alias("seeds"), (F.col(k) / (F.col(f"n_{k}") + PRIOR)).alias("trust"))
                for k in KINDS
            ]
        )
        good = F.filter(ranked, lambda p: (p["seeds"] >= SEEDS) & (p["trust"] >= TRUST))
        patterns = patterns.select("pattern", F.explode(good).alias("best")).select("pattern", "best.kind", "best.trust")
        unseen = edges.where("seed is null").select("value", "may", "pattern").join(patterns, "pattern")
        scores = unseen.where(F.expr("array_contains(may, kind)")).groupBy("value", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.999)))))).alias("score")
        )
        best = scores.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("b"))
        trusted = materialize(best.select("value", "b.kind", "b.score"), "pii-values")
    return trusted


def _all_spans(df: DataFrame, rounds: int) -> DataFrame:
    """(doc_id, key, copies, base, more): sorted spans of each document, of the fixed patterns and beyond them."""
    located = materialize(_located(df), "pii-places")
    tokens = materialize(_tokens(located), "pii-tokens")
    trusted = _trusted_values(tokens, rounds)
    more = tokens.where("seed is null").join(trusted.select("value", "kind"), "value").select("doc_id", "key", "kind", "start", "end")
    rows = located.select(
        "doc_id", "key", "copies", F.when(F.col("kind") != TOKEN, F.col("kind")).alias("kind"), "start", "end", F.lit(True).alias("base")
    ).unionByName(more.withColumns({"copies": F.lit(0).cast("long"), "base": F.lit(False)}))
    span = F.struct("start", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("rank"), "kind", "end")
    return rows.groupBy("doc_id", "key").agg(
        F.max("copies").alias("copies"),
        F.sort_array(F.collect_list(F.when(F.col("base") & F.col("kind").isNotNull(), span))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"),
    )


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(df: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Counts and places of personal data in each whole text.

    `base_sha256` covers the matches of the fixed patterns; `spans` holds these and the identifiers
    found by context. Places count code points; null is an empty text; repeated rows give a row each; texts without
    data have empty spans; an empty table gives no rows; other columns are ignored. Texts never
    move: only matches and tokens do, and no step gathers more than one document's matches.
    """
    counts = [F.size(F.filter("base", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return _all_spans(df, rounds).select(
        "doc_id",
        *counts,
        F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
        F.explode(F.expr("sequence(1L, copies)")).alias("_copy"),
    ).drop("_copy")


def redact(df: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """`df` with each span replaced by its kind in brackets (overlapping spans by that of the first), and
    `n_chars`, where there is one, counted again. All columns and rows stay; null texts stay null."""
    found = _all_spans(df, rounds).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("_llm_id"), F.col("key").alias("_llm_key"), F.col("spans").alias("_llm_spans"))
    rows = df.withColumn("_llm_row", row_key())
    same = rows["doc_id"].cast("long").eqNullSafe(found["_llm_id"]) & (rows["_llm_row"] == found["_llm_key"])
    marked = rows.join(found, same, "left")
    parts = F.aggregate(
        "_llm_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["parts"])
            .otherwise(
                F.concat(
                    acc["parts"],
                    F.array(
                        F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                        F.concat(F.lit("["), s["kind"], F.lit("]")),
                    ),
                )
            )
            .alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    text = F.when(F.col("_llm_spans").isNotNull(), parts).otherwise(F.col("text"))
    out = marked.withColumn("text", text)
    if "n_chars" in df.columns:
        out = out.withColumn("n_chars", F.when(F.col("_llm_spans").isNotNull(), F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*df.columns)
