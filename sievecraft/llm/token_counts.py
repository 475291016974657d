"""Token counts with a cache keyed by digests of normalised content and tokenizer version."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from importlib.util import find_spec
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, new_path
from ._shared import stored as there

PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE = "digest string, version string, n_tokens long"


def default_ranks() -> str:
    return str(Path(find_spec("public_tokenizers").origin).parent / "byte_bpe_50k.tiktoken")


def tokenizer_version(ranks: str, pattern: str = PATTERN) -> str:
    """Digest of all that decides the counts: vocabulary, split pattern, library version."""
    import tiktoken

    h = hashlib.sha256(Path(ranks).read_bytes())
    h.update(f"\0{pattern}\0{tiktoken.__version__}".encode())
    return h.hexdigest()


@lru_cache(2)
def _encoder(ranks: str, pattern: str):
    import tiktoken

    pairs = (line.split() for line in Path(ranks).read_bytes().splitlines())
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def normalised(text: Column) -> Column:
    """Line ends as \\n, no spaces at either end; null as ""."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"))


def token_counts(docs: DataFrame, cache: str | None = None, ranks: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id, digest, n_tokens for every row of docs; cache: folder of the stored counts, a new one if None.

    Each distinct normalised content that has no count for this tokenizer version is encoded once and its count
    appended to the cache; everything else is a join by digest. Null and empty texts count 0 tokens; rows that
    repeat are all returned; an empty table gives an empty result; other columns aren't read. If two runs
    append the same digest, readers take one of the equal counts.
    """
    spark = docs.sparkSession
    ranks = ranks or default_ranks()
    version = tokenizer_version(ranks, pattern)
    path = cache or new_path(spark, "token-cache")

    def stored() -> DataFrame:
        t = spark.read.schema(_CACHE).parquet(path) if there(spark, path) else spark.createDataFrame([], _CACHE)
        return t.filter(F.col("version") == version).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks, pattern)
        for b in rows:
            n = [len(enc.encode_ordinary(t)) for t in b.column("content").to_pylist()]
            yield pa.record_batch({"digest": b.column("digest"), "version": pa.array([version] * len(n), pa.string()), "n_tokens": pa.array(n, pa.int64())})

    content = normalised(F.col("text"))
    by_digest = docs.select(F.sha2(content, 256).alias("digest"), content.alias("content"))
    misses = by_digest.join(stored(), "digest", "left_anti").groupBy("digest").agg(F.first("content").alias("content"))
    misses.mapInArrow(encode, _CACHE).write.mode("append").parquet(path)
    return docs.select("doc_id", F.sha2(content, 256).alias("digest")).join(stored(), "digest", "left").select("doc_id", "digest", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
