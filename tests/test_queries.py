import glob
from pathlib import Path

import duckdb
import pytest

from sievecraft.operators.chunking import chunk_text
from sievecraft.plans.queries import ORACLES, QUERIES
from sievecraft.sources.documents import html_text


def flat(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(flat(v) for v in r) for r in df.select(*names).collect())
    assert got == sorted(tuple(flat(v) for v in r) for r in want.fetchall())


def chunks(text, size, overlap):
    """Brute force: split at blank lines, then sentences, then spaces, merging as long as it fits."""
    import re

    def merge(parts, joiner):
        out = [""]
        for p in parts:
            if out[-1] and len(out[-1] + joiner + p) > size:
                out.append("")
            out[-1] = out[-1] + joiner + p if out[-1] else p
        return [x for x in out if x]

    text = (text or "").strip()
    cut = merge(re.split(r"\n\n+", text), "\n\n") if text else []
    for pattern, joiner in ((r"(?<=\. )", "\n\n"), (" ", " ")):
        cut = [y for x in cut for y in ([x] if len(x) <= size else merge(re.split(pattern, x), joiner))]
    return [(cut[i - 1][-overlap:] if i and overlap else "") + x for i, x in enumerate(cut)]


@pytest.mark.parametrize("size, overlap", [(1000, 200), (300, 0)])
def test_chunks_of_the_documents(spark, data, duck, size, overlap):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunk_text(docs, size, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    want = {i: chunks(t, size, overlap) for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    assert got == {i: c for i, c in want.items() if c}


def test_html_of_the_pages(spark, data, duck):
    got = {r["page_id"]: r["text"] for r in QUERIES["html_text"](spark, data).collect()}
    want = {i: html_text(h) for i, h in duck.execute("SELECT page_id, html FROM pages").fetchall()}
    assert got == want
    assert all("<script" not in t and "</" not in t for t in got.values())
    assert QUERIES["html_chunks"](spark, data).filter("length(chunk) = 0").count() == 0
