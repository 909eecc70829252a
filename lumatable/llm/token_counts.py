"""Exact token counts by looking up pre-tokens, without a shuffle of pre-tokens."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumatable.llm.common import content, materialize, worker_state

MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # what the library writes for a blank
# No piece of the vocabulary holds a blank behind another character, or a line feed; no merge crosses
# these places, so a text's count is the sum over its parts. The constructor of Lengths checks this.
PARTS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
MEMO_CHARS = 64  # longer parts are counted each time


class Lengths(dict):
    """Pre-token -> token count: the broadcast table first, then a bounded memo of what was encoded."""

    def __init__(self, path: str, frequent: dict[str, int], limit: int):
        super().__init__(frequent)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.frequent, self.limit = frequent, limit + len(frequent)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", piece) for piece in pieces):
            raise ValueError(f"{path}: pieces cross blanks, so counts do not add up over pre-tokens")
        self.lead = len(self.model.encode("\n"))

    def __missing__(self, part: str) -> int:
        # The line feed takes the library's leading blank, so that the part stands as inside a text.
        count = len(self.model.encode("\n" + part)) - self.lead
        if len(part) <= MEMO_CHARS:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[part] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, PARTS.findall(SPACE + text.replace(" ", SPACE))))


def frequent_parts(df: DataFrame, path: str, sample_rows: int, entries: int) -> dict[str, int]:
    """Token counts of the commonest pre-tokens in a sample of about `sample_rows` rows over the whole table.

    Each task counts its own part of the sample; counts are added up before the commonest are taken. The
    sample only decides what is looked up and what is encoded; token counts are the same with any table.
    """
    total = df.count()
    if not total:
        return {}
    texts = df.select(content().alias("text"))
    if total > sample_rows:
        texts = texts.sample(fraction=sample_rows / total, seed=5)
    lengths = Lengths(path, {}, entries)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(p for p in PARTS.findall(SPACE + text.replace(" ", SPACE)) if len(p) <= MEMO_CHARS)
                if len(seen) > 8 * entries:
                    seen = Counter(dict(seen.most_common(4 * entries)))  # rare ones give way in a task with many
        top = seen.most_common(entries)
        yield pd.DataFrame({"part": [p for p, _ in top], "n": [n for _, n in top]})

    counted = texts.mapInPandas(parts, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    # Written first, so that the tasks' tops are merged by a task and only the last of them comes to the driver.
    top = materialize(counted.orderBy(F.desc("n"), "part").limit(entries), "token-parts")
    return {row["part"]: lengths[row["part"]] for row in top.collect()}


def count_tokens(
    df: DataFrame,
    path: str | None = None,
    limit: int = 4096,
    sample_rows: int = 2000,
    entries: int = 32_768,
    memo: int = 400_000,
) -> DataFrame:
    """Bytes, tokens and whether the tokens exceed `limit`, for each whole text.

    A table of at most `entries` frequent pre-tokens (from `sample_rows` texts) is broadcast; what
    it misses is encoded once and kept in a memo of at most `memo` entries per worker. One pass,
    no shuffle. Null and empty texts have no tokens; repeated rows are counted each; an empty table
    gives no rows; other columns are ignored.
    """
    path = path or public_tokenizers.path(MODEL)
    run = uuid.uuid4().hex  # tells this call's table from another's
    table = df.sparkSession.sparkContext.broadcast(frequent_parts(df, path, sample_rows, entries))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = worker_state(("lengths", path, run, memo), lambda: Lengths(path, table.value, memo))
        for texts in batches:
            yield pd.Series([lengths.count(text) for text in texts], dtype="int64")

    return (
        df.select("doc_id", content().alias("text"))
        .select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
