"""The registered text queries against SQL, and the pipeline's stages against brute force."""

import os

import duckdb
import pytest
from test_counts_packing_sharding import check_packing
from test_dedup import groups, slow_print
from test_text_filters import base_spans, brute_hits
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from lumatable.llm import packing, plans
from lumatable.llm.common import materialize

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(plans.ORACLES[name])
    names = [column[0] for column in want.description]
    got = plans.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_names():
    assert [name.split("_")[0] for name in sorted(plans.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    results = []
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r["doc_id"], r["text"]) for r in docs.collect())
        docs = materialize(stage(spark, docs, SF), name)
        results.append((before, docs))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(df.columns == columns for _, df in results[:-1])
    rows = [sorted((r["doc_id"], r["text"]) for r in df.collect()) for _, df in results[:-1]]
    before = results[0][0]
    assert rows[0] == [r for r in before if any(c.isalpha() for c in r[1])]
    root = groups([slow_print(t) for _, t in rows[0]])
    assert rows[1] == [r for k, r in enumerate(rows[0]) if root.index(root[k]) == k]
    assert rows[2] == [r for r in rows[1] if not brute_hits(r[1], items)[-1]]
    assert len(rows[3]) == len(rows[2])
    for (_, old), (_, new) in zip(rows[2], rows[3], strict=True):
        assert not base_spans(new)
        assert (old == new) == (not base_spans(old))
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    check_packing(rows[3], docs.collect(), packing.CAPACITY, tokenizer)
