"""Benchmark decontamination: token windows of documents against the n-grams of test items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumatable.llm.common import lower_ascii, materialize, row_key

# Words: runs of digits, letters a-z and anything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
HELD = 1 << 22  # n-gram hashes broadcast at once, 8 bytes each before Spark's own table


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _hashed(rows: DataFrame, text: str = "text") -> DataFrame:
    """`rows` with their words `w` and the hashes `wh` of these.

    Both are made by generators: what a lambda refers to must be made once per row, and Spark would
    put a projection into the lambda.
    """
    kept = [c for c in rows.columns if c != text]
    split = rows.select(*kept, F.explode(F.array(words(F.col(text)))).alias("w"))
    return split.select("*", F.explode(F.array(F.transform("w", lambda word: F.xxhash64(word)))).alias("wh"))


def _taken(array: str, at: str, size: int) -> str:
    """The elements of a window one by one: `slice` would copy the whole array for each window."""
    return ", ".join(f"get({array}, {at} + {k})" for k in range(size))


def _windows(size: int) -> str:
    """SQL for the windows of `size` words of a row with `w` and `wh`: (at, size, h)."""
    places = f"if(size(w) >= {size}, sequence(0, size(w) - {size}), cast(array() as array<int>))"
    return f"transform({places}, i -> named_struct('at', i, 'size', {size}, 'h', xxhash64({_taken('wh', 'i', size)})))"


def _text(sizes: list[int]) -> str:
    """SQL for the text of the window at `at` of `size` words."""
    cases = " ".join(f"when {size} then concat_ws(' ', {_taken('w', 'at', size)})" for size in sizes)
    return f"case size {cases} end"


class Matcher:
    """The n-grams of the test items: their hashes, and which items hold each.

    An item shorter than the window is one n-gram; items without words or id have none.
    """

    def __init__(self, items: DataFrame, window: int = WINDOW, held: int = HELD):
        named = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
        split = _hashed(named).where("size(w) > 0").withColumn("size", F.least(F.size("w"), F.lit(window)))
        sizes = list(range(1, window + 1))
        windows = " ".join(f"when {size} then {_windows(size)}" for size in sizes)
        made = split.select("item_id", "w", F.expr(f"inline(case size {windows} end)"))
        made = made.select("item_id", "size", "h", F.expr(_text(sizes)).alias("gram"))
        self.items = materialize(made.distinct(), "test-grams")
        hashes = self.items.select("h").distinct()
        self.parts = max(1, -(-hashes.count() // held))
        self.hashes = hashes
        self.sizes = sorted(row["size"] for row in self.items.select("size").distinct().collect())  # at most `window`

    def mark(self, df: DataFrame) -> DataFrame:
        """One row (doc_id, key, n_words) per document, and one (doc_id, key, at, size, gram) per verified hit.

        Every window is hashed in its row and looked up in a broadcast set of n-gram hashes, of `held` at
        most; a larger test set takes several passes over the documents. Only what is found leaves its
        row: its text is then compared by an equi-join with the n-grams.
        """
        rows = _hashed(df.select("doc_id", row_key().alias("key"), "text"))
        found = None
        for part in range(self.parts):
            document = "array(named_struct('at', -1, 'size', 0, 'h', cast(null as bigint)))"
            made = rows.select("doc_id", "key", "w", F.expr(f"inline(concat({', '.join([document, *map(_windows, self.sizes)])}))"))
            hashes = self.hashes.where(F.pmod("h", F.lit(self.parts)) == part).select(F.col("h").alias("known"))
            met = made.join(F.broadcast(hashes), F.col("h") == F.col("known"), "left")
            met = met.where("known is not null" if part else "known is not null or at < 0").select(
                "doc_id", "key", "at", "size",
                F.when(F.col("at") < 0, F.size("w")).cast("long").alias("n_words"),
                (F.expr(_text(self.sizes)) if self.sizes else F.lit(None).cast("string")).alias("gram"),
            )
            found = met if found is None else found.unionByName(met)
        return materialize(found, "test-windows")

    def verified(self, marked: DataFrame) -> DataFrame:
        """The hits whose text is an n-gram: (doc_id, key, at, size, gram)."""
        texts = self.items.select("gram", "size").distinct()
        return marked.where("at >= 0").select("doc_id", "key", "at", "size", "gram").join(texts, ["gram", "size"])

    def starts(self, df: DataFrame) -> DataFrame:
        """(id, found, starts) of the documents with hits, one row per id and text."""
        hits = self.verified(self.mark(df))
        return hits.groupBy(F.col("doc_id").alias("_llm_id"), F.col("key").alias("_llm_found")).agg(
            F.collect_set(F.struct("at", "size")).alias("_llm_starts")
        )


def _hit_words(starts: str) -> str:
    return f"array_distinct(flatten(transform({starts}, s -> sequence(s.at, s.at + s.size - 1))))"


def find_contamination(df: DataFrame, items: DataFrame, window: int = WINDOW, held: int = HELD) -> DataFrame:
    """Words of each document inside any occurrence of a test window, and the items found.

    Which items hold a set of n-grams is worked out once per set, not per document: copies of a passage
    share their set. Null and empty texts have no words; items without words or id never occur;
    repeated rows each give a row; empty tables give no rows or no hits; other columns are ignored.
    """
    matcher = Matcher(items, window, held)
    marked = matcher.mark(df)
    hits = matcher.verified(marked).groupBy("doc_id", "key").agg(
        F.collect_set(F.struct("at", "size")).alias("starts"), F.sort_array(F.collect_set("gram")).alias("grams")
    )
    hits = materialize(
        hits.select(
            F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.expr(f"size({_hit_words('starts')})").alias("hit"),
            "grams", F.sha2(F.array_join("grams", "\n").cast("binary"), 256).alias("held"),
        ),
        "test-hits",
    )
    sets = hits.groupBy("held").agg(F.first("grams").alias("grams")).select("held", F.explode("grams").alias("gram"))
    named = sets.join(matcher.items.select("gram", "item_id").distinct(), "gram").groupBy("held").agg(
        F.sort_array(F.collect_set("item_id")).alias("items")
    )
    named = named.select(
        "held", F.size("items").cast("long").alias("found"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("digest")
    )
    documents = marked.where("at < 0").select("doc_id", "key", "n_words")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    joined = documents.join(hits.drop("grams").join(named, "held"), same, "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("found", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.col("hit").isNotNull().alias("contaminated"),
    )


def remove_contaminated(
    df: DataFrame, items: DataFrame, spans: bool = False, window: int = WINDOW, held: int = HELD
) -> DataFrame:
    """`df` without contaminated documents; with `spans`, without the words hit but with the documents.

    All columns stay. The documents are joined with the keys of those with hits, which Spark broadcasts
    while they are few.
    """
    columns = df.columns
    found = Matcher(items, window, held).starts(df)
    keyed = df.withColumn("_llm_key", row_key())
    same = F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_key") == F.col("_llm_found"))
    if not spans:
        return keyed.join(found.select("_llm_id", "_llm_found"), same, "left_anti").select(*columns)
    marked = keyed.join(found, same, "left")
    word = WORD.replace(r"\x60", r"\x40\x5B-\x60")  # the same words before lower-casing
    # Generators again: what a lambda refers to must be made once per row.
    parts = F.struct(
        F.expr(f"map_from_entries(transform({_hit_words('_llm_starts')}, i -> struct(i, true)))").alias("_llm_hits"),
        F.regexp_extract_all(F.col("text"), F.lit(word), F.lit(0)).alias("_llm_words"),
        F.split("text", word, -1).alias("_llm_gaps"),
    )
    cut = marked.select("*", F.inline(F.array(parts)))
    kept = F.expr(
        "concat(array_join(transform(_llm_words, (x, i) -> concat(get(_llm_gaps, i),"
        " if(map_contains_key(_llm_hits, i), '', x))), ''), element_at(_llm_gaps, -1))"
    )
    text = F.when(F.expr("size(_llm_starts) > 0"), kept).otherwise(F.col("text"))
    return cut.select(*[text.alias("text") if c == "text" else F.col(c) for c in columns])


ORACLE_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
windows AS (
  SELECT r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS gram
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM doc_words, (SELECT DISTINCT m FROM grams) WHERE len(w) >= m)),
hits AS (SELECT r, i, g.m, item_id FROM windows JOIN grams g USING (gram, m)),
hit_words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
hit_items AS (
  SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words h USING (r) LEFT JOIN hit_items i USING (r)
"""
