"""Substring dedup: Rabin-Karp hashes of every window of fixed length, counted; repeated ones merge into spans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SENT, SPANS, Tokens, answers, batches, blobs, chunked, documents, exchange, seen_twice, sorted_rows, span_table, spans


def repeated_spans(docs: DataFrame, width: int = 50, chunk_bytes: int = 12 << 20, bucket_keys: int = 2 << 20) -> DataFrame:
    """doc_id, start_token, end_token, start_char, end_char: the maximal spans made of windows of width
    white-space tokens that occur twice or more in docs, in one text or in several. Ends are exclusive.

    Spans that overlap or touch are one. All occurrences are returned, the first as well. Null and empty texts and
    those of fewer tokens have none; a repeated row repeats all its windows and its spans come once for each
    row; a null doc_id stays null; an empty table gives an empty result; other columns aren't read.

    A window's hash goes to the bucket of its key range once per chunk; nothing but one bit per hash comes
    back. chunk_bytes of text and bucket_keys bound a Python worker's memory; neither changes the result.
    """
    # shorter texts, null and empty ones among them, have no window and don't meet in one chunk
    rows, _, size = chunked(docs.filter(F.octet_length("text") >= 2 * width - 1), chunk_bytes, "doc_id", "text")
    buckets = max(1, -(-size // 6 // bucket_keys))

    def hashes(texts: list) -> np.ndarray:
        return np.concatenate([Tokens(texts[a:b]).windows(width)[0] for a, b in batches(texts)])

    def send(t: pa.Table) -> pa.Table:
        return blobs(t.column("chunk")[0].as_py(), np.unique(hashes(sorted_rows(t)[1])), None, buckets)

    def merge(t: pa.Table, found: pa.Table) -> pa.Table:
        if not t.num_rows:
            return span_table([])
        ids, texts = sorted_rows(t)
        keys, n = np.unique(hashes(texts), return_counts=True)
        repeated = keys[answers(found, keys, buckets) | (n > 1)]
        parts = []
        for a, b in batches(texts):
            tokens = Tokens(texts[a:b])
            w, at = tokens.windows(width)
            if len(repeated) and len(w):
                i = np.minimum(np.searchsorted(repeated, w), len(repeated) - 1)
                parts.append(spans(tokens, at[repeated[i] == w], width, ids[a:b]))
        return span_table(parts)

    found = exchange(rows.groupBy("chunk").applyInArrow(send, SENT), seen_twice)
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(merge, SPANS)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir)).select("doc_id", "start_token", "end_token")


def spans_sql(width: int = 50) -> str:
    return rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(len(w) - {width - 1})) AS i FROM t WHERE len(w) >= {width}),
h AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + {width}], ' ')) AS h FROM i),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT *, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{width + 1}) > {width} AS fresh FROM r),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g)
SELECT doc_id, min(i)::INT AS start_token, (max(i) + {width})::INT AS end_token FROM s GROUP BY doc_id, span"""


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {"op5_substring_dedup": spans_sql()}
