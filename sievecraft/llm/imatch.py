"""Document fingerprints: I-Match over terms in a band of inverse document frequency, with randomised lexicons."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import NOT_WORD, SENT, Tokens, answers, batches, blobs, chunked, documents, exchange, find, mix, sorted_rows

_U = np.uint64
_FOLD = 0xD6E8FEB86659FD93
FINGERPRINTS = "doc_id long, n_terms int, fingerprints array<long>"


def terms(texts: list) -> list[np.ndarray]:
    """Sorted distinct term hashes of each text; a term is a run of letters and digits in lower case."""
    out = []
    for a, b in batches(texts):
        t = Tokens([(x or "").lower() for x in texts[a:b]], NOT_WORD)
        out += [np.unique(t.hash[i:j]) for i, j in zip(t.first[:-1], t.first[1:])]
    return out


def fingerprints(lists: list[np.ndarray], lexicons: int, keep: float, least: int = 6) -> np.ndarray:
    """A hash of each list's terms in each lexicon, in order; row per list, 0 for an empty list.

    Lexicon k keeps a term if its hash with seed k falls below keep, the same in all documents. A list with fewer
    than least such terms takes its least terms with the lowest hashes, or all it has, so that no print rests on
    a few chance terms and a short list has prints as well.
    """
    size = np.array([len(x) for x in lists])
    out = np.zeros((len(lists), lexicons), _U)
    if not size.sum():
        return out
    flat = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), size)
    powers = np.multiply.accumulate(np.full(int(size.max()) + 1, _FOLD, _U))
    for k in range(lexicons):
        score = mix(flat ^ mix(np.array([k + 1], _U))) >> _U(11)
        chosen = score < _U(int(keep * 2**53))
        poor = np.flatnonzero((np.bincount(owner[chosen], minlength=len(lists)) < least)[owner])
        poor = poor[np.lexsort((score[poor], owner[poor]))]
        first = np.flatnonzero(np.append(True, owner[poor][1:] != owner[poor][:-1])) if len(poor) else poor
        rank = np.arange(len(poor)) - np.repeat(first, np.diff(np.append(first, len(poor))))
        chosen[poor[rank < least]] = True
        t, o = flat[chosen], owner[chosen]
        n = np.bincount(o, minlength=len(lists))
        place = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
        full = np.flatnonzero(n)
        if len(full):
            sums = np.add.reduceat(mix(t) * powers[place], (np.cumsum(n) - n)[full])
            out[full, k] = np.maximum(mix(sums + n[full].astype(_U)), _U(1))
    return out


def document_fingerprints(docs: DataFrame, band: tuple[float, float] = (0.25, 0.8), lexicons: int = 16, keep: float = 0.03, chunk_bytes: int = 12 << 20, bucket_keys: int = 1 << 20, least: int = 6) -> DataFrame:
    """doc_id, n_terms, fingerprints for every row of docs.

    band: lexicon terms have idf ln(N / df) between these shares of ln N, N the count of rows and df the count of
    rows that hold the term. n_terms counts a row's distinct terms in the band; fingerprints has one hash per
    randomised lexicon (see fingerprints() for keep and least), null where the row has no term in the band: so for
    null and empty texts. Documents that share any fingerprint are taken as duplicates; equal sets of terms share
    all. A small keep drops most terms that near copies differ in; many lexicons give as many chances. Repeated
    rows count each; a null doc_id stays null; an empty table gives an empty result; other columns aren't read.
    """
    rows, _, size = chunked(docs, chunk_bytes, "doc_id", "text")
    n = docs.count()
    buckets = max(1, -(-size // 10 // bucket_keys))
    low, high = (n ** (1 - band[1]), n ** (1 - band[0])) if n else (0, 0)
    low, high = math.ceil(low - 1e-9), math.floor(high + 1e-9)

    def send(t: pa.Table) -> pa.Table:
        keys, df = np.unique(np.concatenate([np.zeros(0, _U), *terms(sorted_rows(t)[1])]), return_counts=True)
        return blobs(t.column("chunk")[0].as_py(), keys, df.reshape(-1, 1), buckets)

    def in_band(keys: list[np.ndarray], df: list[np.ndarray]) -> list[np.ndarray]:
        names, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(df)[:, 0], len(names))
        return np.split(((total >= low) & (total <= high))[at], np.cumsum([len(k) for k in keys])[:-1])

    def finish(t: pa.Table, found: pa.Table) -> pa.Table:
        types = pa.schema([("doc_id", pa.int64()), ("n_terms", pa.int32()), ("fingerprints", pa.list_(pa.int64()))])
        if not t.num_rows:
            return types.empty_table()
        ids, texts = sorted_rows(t)
        lists = terms(texts)
        keys = np.unique(np.concatenate([np.zeros(0, _U), *lists]))
        lexicon = keys[answers(found, keys, buckets)]
        lists = [x[find(lexicon, x)[0]] for x in lists]
        prints = fingerprints(lists, lexicons, keep, least).view(np.int64)
        flat = pa.array(prints.reshape(-1), mask=(prints == 0).reshape(-1))
        return pa.table([pa.array(ids, pa.int64()), pa.array([len(x) for x in lists], pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * lexicons), flat)], schema=types)

    found = exchange(rows.groupBy("chunk").applyInArrow(send, SENT), in_band)
    return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(finish, FINGERPRINTS)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(documents(spark, sf_dir))


QUERIES = {"op7_document_fingerprints": op7_document_fingerprints}
ORACLES: dict[str, str] = {}
