"""Repeated substrings by hashes of fixed windows and a difference-cover sample, in place of a suffix array.

No suffix array and no order of the suffixes is made: ranks are places in sorted hashes of sample windows and tell
equal from different only. The spans are those that a suffix array would give for substrings of width tokens or more.

{0, 1, 3} covers all differences modulo 7: for any two positions i and j there is a d < 7 such that i + d and j + d are
both congruent to 0, 1 or 3. The suffixes at such positions, cut to DEPTH tokens, are ranked first, in the order of their
hashes. Two suffixes whose first 7 tokens and whose tokens DEPTH to width agree are then equal over width tokens exactly if the ranks at the d of
their residues are equal, so that a bucket needs three ranks of a suffix and never its tokens. Suffixes whose three ranks
are all unique can't repeat and are dropped before they are sent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SENT, SPANS, Tokens, answers, batches, blobs, bucket_of, chunked, documents, exchange, find, mix, ranges, sorted_rows, span_table, spans, table
from .windows import spans_sql

PERIOD, COVER = 7, (0, 1, 3)
_U = np.uint64
#: For each residue, the three offsets below PERIOD at which a suffix meets the cover.
_OFFSETS = np.array([[d for d in range(PERIOD) if (r + d) % PERIOD in COVER] for r in range(PERIOD)])


class _Part:
    """Tokens of some texts, with the suffixes of width tokens or more and the cover sample's names."""

    def __init__(self, texts: list, width: int):
        self.tokens, self.width, self.depth = Tokens(texts), width, width - PERIOD + 1
        t = self.tokens
        names, at = t.windows(self.depth)
        place = at - np.repeat(t.first[:-1], np.maximum(np.diff(t.first) - self.depth + 1, 0))
        chosen = np.isin(place % PERIOD, COVER)
        self.sample, self.names = at[chosen], names[chosen]

    def suffixes(self, ranked: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First token, key (hash of both ends), and (residue, three ranks) of each suffix that may repeat."""
        t, w = self.tokens, self.width
        known, i = find(ranked, self.names)
        rank = np.zeros(len(t.hash) + PERIOD, _U)
        if len(ranks):
            rank[self.sample] = np.where(known, ranks[i], _U(0))
        counts = np.maximum(np.diff(t.first) - w + 1, 0)
        at = ranges(t.first[:-1], counts)
        residue = (at - np.repeat(t.first[:-1], counts)) % PERIOD
        three = rank[at[:, None] + _OFFSETS[residue]]
        may = three.any(axis=1)
        at, residue, three = at[may], residue[may], three[may]
        ends = np.zeros((2, len(t.hash) + 1), _U)
        for end, size in zip(ends, (PERIOD, w - self.depth)):
            hashes, first = t.windows(size)
            end[first] = hashes
        key = mix(ends[0][at] * _U(0x9E3779B97F4A7C15) + ends[1][at + self.depth])
        return at, key, np.column_stack([residue.astype(np.uint32), np.ascontiguousarray(three).view(np.uint32).reshape(-1, 6)])


def _rank(keys: list[np.ndarray], extra: list[np.ndarray]) -> list[np.ndarray]:
    """Ranks, from 1, of a bucket's sample names that occur twice; 0 for those that occur once."""
    merged = np.sort(np.concatenate([np.concatenate(keys), *[k[e[:, 0] > 1] for k, e in zip(keys, extra)]]))
    twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
    out = []
    for k in keys:
        known, at = find(twice, k)
        out.append(np.where(known, at + 1, 0).astype(np.uint32))
    return out


def _resolve(keys: list[np.ndarray], extra: list[np.ndarray]) -> list[np.ndarray]:
    """Which suffixes of a bucket equal another: the bucket is sorted by hash, ties by the rank at the common offset."""
    key, more = np.concatenate(keys), np.concatenate(extra)
    three, offsets = np.ascontiguousarray(more[:, 1:]).view(_U), _OFFSETS[more[:, 0]]
    found = np.zeros(len(key), bool)
    for d in range(PERIOD):
        row, col = np.nonzero((offsets == d) & (three > 0))
        order = row[np.lexsort((three[row, col], key[row]))]
        rank = np.zeros(len(key), _U)
        rank[row] = three[row, col]
        same = (key[order][1:] == key[order][:-1]) & (rank[order][1:] == rank[order][:-1])
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
    return np.split(found, np.cumsum([len(k) for k in keys])[:-1])


def repeated_suffixes(docs: DataFrame, width: int = 50, chunk_bytes: int = 8 << 20, bucket_keys: int = 2 << 20) -> DataFrame:
    """doc_id, start_token, end_token, start_char, end_char: maximal spans of repeated substrings of width tokens
    or more (white-space tokens), found by hashes of windows and not in the order of suffixes. Ends are exclusive.

    Spans that overlap or touch are one; every occurrence is returned. Null and empty texts and those of fewer
    tokens have none; repeated rows repeat; a null doc_id stays null; an empty table gives an empty result;
    other columns aren't read. chunk_bytes and bucket_keys bound memory and don't change the result.

    Ranks are local to a bucket of sample names: rank and bucket number together name a class of samples, and
    both go into the rank that a suffix carries.
    """
    # shorter texts, null and empty ones among them, have no suffix of width tokens and don't meet in one chunk
    rows, _, size = chunked(docs.filter(F.octet_length("text") >= 2 * width - 1), chunk_bytes, "doc_id", "text")
    buckets = max(1, -(-size // 12 // bucket_keys))

    def names(texts: list) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([_Part(texts[a:b], width).names for a, b in batches(texts)]), return_counts=True)

    def send_sample(t: pa.Table) -> pa.Table:
        keys, n = names(sorted_rows(t)[1])
        return blobs(t.column("chunk")[0].as_py(), keys, np.minimum(n, 2).reshape(-1, 1), buckets)

    def ranked(texts: list, found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The sample names that repeat and a rank for each that is its own in all buckets."""
        keys, _ = names(texts)
        local = answers(found, keys, buckets, np.uint32)
        bucket = bucket_of(keys, buckets).astype(_U)
        good = local > 0
        return keys[good], (bucket[good] << _U(32)) | local[good].astype(_U)

    def suffixes(texts: list, found: pa.Table):
        known, ranks = ranked(texts, found)
        parts = []
        for a, b in batches(texts):
            part = _Part(texts[a:b], width)
            parts.append((a, b, part, *part.suffixes(known, ranks)))
        return parts

    def send(t: pa.Table, found: pa.Table) -> pa.Table:
        if not t.num_rows:
            return blobs(0, np.zeros(0, _U), None, 1)
        parts = suffixes(sorted_rows(t)[1], found)
        key = np.concatenate([p[4] for p in parts])
        order = np.argsort(key, kind="stable")
        return blobs(t.column("chunk")[0].as_py(), key[order], np.concatenate([p[5] for p in parts])[order], buckets)

    def merge(t: pa.Table, both: pa.Table) -> pa.Table:
        if not t.num_rows:
            return span_table([])
        ids, texts = sorted_rows(t)
        sample = pa.compute.equal(both.column("kind"), 0)
        parts = suffixes(texts, both.filter(sample))
        key = np.concatenate([p[4] for p in parts])
        order = np.argsort(key, kind="stable")
        repeated = np.zeros(len(key), bool)
        repeated[order] = answers(both.filter(pa.compute.invert(sample)), key[order], buckets)
        out, begin = [], 0
        for a, b, part, at, *_ in parts:
            mine = at[repeated[begin : begin + len(at)]]
            begin += len(at)
            if len(mine):
                out.append(spans(part.tokens, mine, width, ids[a:b]))
        return span_table(out)

    ranks = table(exchange(rows.groupBy("chunk").applyInArrow(send_sample, SENT), _rank), "cover-ranks")
    order = exchange(rows.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(send, SENT), _resolve)
    both = ranks.withColumn("kind", F.lit(0)).unionByName(order.withColumn("kind", F.lit(1)))
    return rows.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(merge, SPANS)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_suffixes(documents(spark, sf_dir)).select("doc_id", "start_token", "end_token")


QUERIES = {"op8_suffix_array_dedup": op8_suffix_array_dedup}
ORACLES = {"op8_suffix_array_dedup": spans_sql()}
