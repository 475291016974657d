import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievecraft import llm

from . import brute
from .test_operators import near_roots, rows


def _tables(data):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_queries_equal_their_sql(spark, data, name):
    df = llm.queries()[name](spark, data)
    names = sorted(df.columns)
    want = sorted((tuple(r) for r in _tables(data).execute(f"SELECT {', '.join(names)} FROM ({llm.oracle_sql()[name]})").fetchall()), key=repr)
    assert rows(df.select(*names)) == want


def test_queries_are_numbered():
    assert sorted(int(q[2:].split("_")[0]) for q in llm.queries() if q.startswith("op")) == list(range(1, 11))


def test_near_groups_of_the_documents(spark, data):
    docs = [(r[0], r[1]) for r in _tables(data).execute("SELECT doc_id, text FROM documents").fetchall()]
    got = {r["doc_id"]: r["group_id"] for r in llm.queries()["op6_simhash_near_dedup"](spark, data).collect()}
    assert got == brute.near_groups(docs)


def test_lines_of_the_documents(spark, data):
    docs = [(r[0], r[1]) for r in _tables(data).execute("SELECT doc_id, text FROM documents").fetchall()]
    got = sorted((r["doc_id"], r["text"]) for r in llm.queries()["op1_line_dedup"](spark, data).collect())
    assert got == brute.dedup_lines(docs)


def test_recall_on_the_lines_of_the_documents(spark, data):
    texts = [r[0] for r in _tables(data).execute("SELECT text FROM documents WHERE text IS NOT NULL").fetchall()]
    all_ = sorted({brute.strip(x) for t in texts for x in t.split("\n")} - {""})
    root, want = near_roots(spark, all_), brute.line_pairs(all_)
    assert len(want) > 0 and sum(root[all_[i]] == root[all_[j]] for i, j in want) >= 0.9 * len(want)


def test_pipeline_against_brute_force(spark, data):
    docs = [(r[0], r[1]) for r in _tables(data).execute("SELECT doc_id, text FROM documents").fetchall()]
    docs = brute.dedup_lines(brute.quality(docs))
    group = brute.near_groups(docs)
    docs = [(i, brute.redacted(t)) for i, t in docs if group.get(i, i) == i]
    out = corpus_pipeline.run(spark, data).collect()
    n = {}
    for r in out:
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + r["n_tokens"]
    sizes = {i: len(brute.SPACES.findall(t)) for i, t in docs}
    assert n == {i: k for i, k in sizes.items() if k}
    assert brute.by_bin(out) == brute.pack(list(sizes.values()), 2048)


def test_stages_keep_columns_and_bear_empty_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("false").withColumn("row", F.lit("own"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == 0
