"""Exact and fuzzy dedup that keep the first row by seq.

Fuzzy dedup is an exact set-similarity self-join. Two shingle sets with Jaccard >= t differ in at most
(1 - t) / (1 + t) * (n1 + n2) shingles, and their sizes by a factor of t at most. Rows are put in order of size and dealt into
blocks; blocks of near sizes are compared by parity sketches, whose bits differ in no more places than the sets do. Only
sketches are moved for that; texts are fetched for what is left. The comparisons grow with the square of the rows, at some 10^8
a second and core: texts of few different shingles, such as those of one language, leave no index that would ask for fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize
from ..sources.samples import with_seq
from ..storage import materialize, spread

_U = np.uint64
_SKETCH = 4
#: Below this threshold sketches tell little; rows then meet by each shingle that they share.
LOW = 0.3
#: Rows of a block at least, and blocks at most: each row goes to the blocks of near sizes, whose number bounds what is moved.
BLOCK, BLOCKS = 2048, 96
#: Rows of found pairs whose texts a task holds at once, twice.
TILE = 512
#: Pairs that one task may settle in order; more go through rounds.
ONE_TASK = 4_000_000


def exact_dedup(samples: DataFrame, text: str = "text") -> DataFrame:
    """Rows without those whose normalised text an earlier row has; null texts are all kept.

    Only digests and seq are shuffled to find the losers, which an anti-join then takes out.
    """
    slim = samples.filter(F.col(text).isNotNull()).select("seq", F.sha2(normalize(F.col(text)), 256).alias("digest"))
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("seq"))
    losers = slim.withColumn("rank", rank).filter("rank > 1").select("seq")
    return samples.join(losers, "seq", "left_anti")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_hashes(text: str, size: int = 3) -> np.ndarray:
    """Sorted distinct hashes of a text's character shingles; a shorter text is one shingle."""
    if len(text) < size:
        text = text + "\0" * (size - len(text))
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    h = p[: len(p) - size + 1]
    for k in range(1, size):
        h = (h << _U(21)) ^ p[k : len(p) - size + 1 + k]
    return np.unique(_mix(h))


def _keys(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for i in range(0, batch.num_rows, 512):
            key, seq, count, sketch = [], [], [], []
            part = batch.slice(i, 512)
            for s, text in zip(part.column("seq").to_pylist(), part.column("norm").to_pylist()):
                k = shingle_hashes(text, size)
                key.append(k)
                seq.append(np.full(len(k), s, np.int64))
                count.append(np.full(len(k), len(k), np.int32))
                sketch.append(np.broadcast_to(_parities(k, _SKETCH).view(np.int64), (len(k), _SKETCH)))
            if key:
                marks = np.concatenate(sketch)
                columns = [np.concatenate(key).view(np.int64), np.concatenate(seq), np.concatenate(count), *marks.T]
                yield pa.record_batch([pa.array(x) for x in columns], names=["key", "seq", "n", *[f"s{j}" for j in range(_SKETCH)]])


def _parities(hashes: np.ndarray, words: int) -> np.ndarray:
    """How many hashes, even or odd, fall to each of 64 * words bits. Its halves, one xor the other, are that of half as many words."""
    at = (hashes >> _U(8)) & _U(64 * words - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)).view(_U)


def _sketches(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """seq, n (shingles) and a sketch of about as many bits, so that sets that differ in half of them show it."""
    for batch in rows:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            sets = [shingle_hashes(x, size) for x in part.column("norm").to_pylist()]
            marks = [_parities(h, max(_SKETCH, 1 << (max(1, len(h) * 4 // 5 // 64) - 1).bit_length())).tobytes() for h in sets]
            yield pa.record_batch([part.column("seq"), pa.array([len(h) for h in sets], pa.int32()), pa.array(marks, pa.binary())], names=["seq", "n", "sketch"])


def _levels(marks: list[bytes]) -> dict[int, tuple[int, np.ndarray]]:
    """For each number of words the first row that has it, and from there on all rows' sketches folded to it, a word of all in a row."""
    size = np.fromiter(map(len, marks), np.int64, len(marks)) // 8
    levels: dict[int, tuple[int, np.ndarray]] = {}
    above = None
    for words in (1 << k for k in reversed(range(int(size.max(initial=1)).bit_length()))):
        at, end = np.searchsorted(size, (words, 2 * words))
        own = np.frombuffer(b"".join(marks[at:end]), _U).reshape(-1, words).T
        above = own if above is None else np.hstack([own, above[:words] ^ above[words:]])
        levels[words] = int(at), np.ascontiguousarray(above)
    return levels


def _near(n: np.ndarray, marks: list[bytes], cut: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of rows in order of n that can have Jaccard >= threshold; with a cut i lies before it and j behind."""
    most = (1 - threshold) / (1 + threshold)
    levels = _levels(marks)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, cut or len(n), 32):
        i_end = min(i + 32, cut or len(n))
        end = int(np.searchsorted(n, n[i_end - 1] / threshold * (1 + 1e-9), side="right"))
        first, words = levels[len(marks[i]) // 8]
        for j in range(cut or i, end, 2048):
            j_end = min(j + 2048, end)
            differ = np.zeros((i_end - i, j_end - j), np.uint16 if len(words) < 1000 else np.uint32)
            for w in words:
                differ += np.bitwise_count(w[i - first : i_end - first, None] ^ w[None, j - first : j_end - first])
            p, q = np.nonzero(differ <= most * float(n[i_end - 1] + n[j_end - 1]) + 1e-9)
            bits, p, q = differ[p, q], p + i, q + j
            ok = (p < q) & (n[p] >= threshold * n[q] - 1e-9) & (bits <= most * (n[p] + n[q]) + 1e-9)
            left.append(p[ok])
            right.append(q[ok])
    return np.concatenate(left), np.concatenate(right)


def _verified(pairs: pa.Table, texts: pa.Table, threshold: float, size: int) -> pa.Table:
    """a, b, jaccard of the pairs that reach threshold; texts (seq, norm) has each of their texts once."""
    seq = texts.column("seq").to_numpy()
    order = np.argsort(seq)
    sets = [shingle_hashes(x, size) for x in texts.column("norm").take(pa.array(order)).to_pylist()]
    held = np.fromiter(map(len, sets), np.int64, len(sets))
    start = np.cumsum(held) - held
    token = np.unique(np.concatenate([np.zeros(0, _U), *sets]), return_inverse=True)[1]
    mark = np.zeros(len(token) + 1, bool)
    a, b = (np.searchsorted(seq[order], pairs.column(c).to_numpy()) for c in "ab")
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    both = np.zeros(len(a), np.int64)
    heads = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
    for i, j in zip(heads, np.append(heads[1:], len(a))):
        own = token[start[a[i]] : start[a[i]] + held[a[i]]]
        mark[own] = True
        for k in range(i, j, 1000):
            to = b[k : min(k + 1000, j)]
            ends = np.cumsum(held[to])
            at = np.arange(ends[-1]) + np.repeat(start[to] - ends + held[to], held[to])
            both[k : k + len(to)] = np.add.reduceat(mark[token[at]], ends - held[to], dtype=np.int64)
        mark[own] = False
    score = both / (held[a] + held[b] - both)
    ok = score >= threshold
    found = seq[order]
    return pa.table({"a": pa.array(found[a[ok]]), "b": pa.array(found[b[ok]]), "jaccard": pa.array(score[ok])})


def similar_pairs(samples: DataFrame, threshold: float = 0.85, size: int = 3, text: str = "text") -> DataFrame:
    """a, b (seq, a < b), jaccard of all pairs of rows whose shingle sets reach threshold and share a shingle.

    Null texts are in no pair. seq must be unique.
    """
    norm = spread(samples.filter(F.col(text).isNotNull()).select("seq", text)).select("seq", normalize(F.col(text)).alias("norm"))
    found = materialize(_share(norm, threshold, size) if threshold < LOW else _candidates(norm, threshold, size), "pairs")
    # rows of found pairs in tiles, those with the same first neighbour together: a text is fetched once for each pair of tiles, not of rows
    ends = found.select(F.col("a").alias("row"), F.col("b").alias("to")).union(found.select("b", "a"))
    rows = with_seq(ends.groupBy("row").agg(F.least("row", F.min("to")).alias("least")), "least", "row")
    rows = rows.select("row", (F.col("seq") / TILE).cast("long").alias("tile"))
    x, y = F.least("x", "y"), F.greatest("x", "y")
    tiled = found.join(rows.select(F.col("row").alias("a"), F.col("tile").alias("x")), "a").join(rows.select(F.col("row").alias("b"), F.col("tile").alias("y")), "b")
    tiled = materialize(tiled.select((F.shiftleft(x, 32) + y).alias("tile"), "a", "b"), "tiled-pairs")
    asked = tiled.select(F.col("tile").alias("of"), F.col("a").alias("seq")).union(tiled.select("tile", "b")).distinct()
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = asked.join(norm, "seq").repartition(parts, "of").groupBy("of")
    return tiled.repartition(parts, "tile").groupBy("tile").cogroup(texts).applyInArrow(lambda p, t: _verified(p, t, threshold, size), "a long, b long, jaccard double")


def _share(norm: DataFrame, threshold: float, size: int) -> DataFrame:
    """Candidates among the pairs that share a shingle."""
    marks = ", ".join(f"s{j} long" for j in range(_SKETCH))
    keys = norm.mapInArrow(lambda rows: _keys(rows, size), f"key long, seq long, n int, {marks}")
    a, b = keys.alias("a"), keys.alias("b")
    differ = sum((F.bit_count(F.col(f"a.s{j}").bitwiseXOR(F.col(f"b.s{j}"))) for j in range(1, _SKETCH)), F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))))
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.seq") < F.col("b.seq"))
    if threshold > 0:
        near &= (F.col("a.n") >= threshold * F.col("b.n")) & (F.col("b.n") >= threshold * F.col("a.n"))
        near &= differ <= F.floor((1 - threshold) / (1 + threshold) * (F.col("a.n") + F.col("b.n")) + 1e-9)
    return a.join(b, near).select(F.col("a.seq").alias("a"), F.col("b.seq").alias("b")).distinct()


def _candidates(norm: DataFrame, threshold: float, size: int) -> DataFrame:
    """Candidates among the pairs of near sizes, block by block."""
    rows = materialize(norm.mapInArrow(lambda rows: _sketches(rows, size), "seq long, n int, sketch binary"), "sketches")
    per = max(BLOCK, -(-rows.count() // BLOCKS))
    placed = with_seq(rows.withColumnRenamed("seq", "row"), "n", "row").withColumn("block", (F.col("seq") / per).cast("int")).drop("seq")
    ends = placed.groupBy("block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    ends = {r["block"]: (r["low"], r["high"]) for r in ends.collect()}  # BLOCKS rows at most
    pairs = [(i, j) for i in ends for j in ends if i <= j and ends[i][1] >= threshold * ends[j][0] - 1e-9]
    to = norm.sparkSession.createDataFrame([(b, f"{i} {j}", b > i) for i, j in pairs for b in {i, j}], "block int, pair string, other boolean")

    def compare(t: pa.Table) -> pa.Table:
        n, seq, other = (t.column(c).to_numpy(zero_copy_only=False) for c in ("n", "row", "other"))
        order = np.lexsort((seq, n, other))  # rows of the other block have at least as many shingles
        seq, marks = seq[order], t.column("sketch").take(pa.array(order)).to_pylist()
        i, j = _near(n[order].astype(np.int64), marks, int((~other).sum()) if other.any() else 0, threshold)
        return pa.table({"a": pa.array(np.minimum(seq[i], seq[j])), "b": pa.array(np.maximum(seq[i], seq[j]))})

    dealt = placed.join(F.broadcast(to), "block").select("pair", "row", "n", "sketch", "other")
    # so few bytes that they would be read in a few tasks, but much work
    return dealt.repartition(max(1, len(pairs)), "pair").groupBy("pair").applyInArrow(compare, "a long, b long")


def greedy_losers(pairs: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """seq of the rows that go if rows are met in order and a row goes if a kept earlier one is its neighbour.

    Up to one_task pairs (checked) are settled by one task; more in rounds: a row with a kept earlier neighbour goes,
    a row whose earlier neighbours have all gone stays.
    """
    pairs = materialize(pairs.select("a", "b"), "similar")
    if pairs.count() <= one_task:

        def settle(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gone: set[int] = set()
            for batch in rows:
                for a, b in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist()):
                    if b not in gone:
                        gone.add(a)
            yield pa.record_batch([pa.array(sorted(gone), pa.int64())], names=["seq"])

        # by the later row, then the earlier one: each earlier row is settled when it is asked for
        return pairs.repartition(1).sortWithinPartitions("b", "a").mapInArrow(settle, "seq long")
    todo = pairs
    lost = None
    while True:
        later = todo.select(F.col("b").alias("seq")).distinct()
        kept = todo.select(F.col("a").alias("seq")).join(later, "seq", "left_anti").distinct()
        gone = materialize(todo.join(kept.withColumnRenamed("seq", "a"), "a", "left_semi").select(F.col("b").alias("seq")).distinct(), "gone")
        lost = gone if lost is None else lost.union(gone)
        rest = todo.join(gone.withColumnRenamed("seq", "b"), "b", "left_anti").join(gone.withColumnRenamed("seq", "a"), "a", "left_anti")
        todo = materialize(rest.select("a", "b"), "similar")
        if todo.isEmpty():
            return lost.distinct()


def deduplicate(samples: DataFrame, threshold: float = 0.85, text: str = "text") -> DataFrame:
    """Exact dedup, then fuzzy dedup unless threshold >= 1. A row goes if an earlier row that stays is similar."""
    unique = exact_dedup(samples, text)
    if threshold >= 1:
        return unique
    return unique.join(greedy_losers(similar_pairs(unique, threshold, text=text)), "seq", "left_anti")
