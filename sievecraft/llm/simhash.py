"""SimHash near-dedup: a self-join of binary tries that accumulates differing bits and prunes beyond a budget."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components, star
from ._shared import NOT_WORD, Tokens, batches, documents, mix, pack, ranges, table, unpack

_U = np.uint64
_ONE = _U(1)
BITS, WORD = 128, 64
_SECOND = _U(0x8A5CD789635D2DFF)


def simhashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of 128 bits (rows of two words) over a text's distinct words (lower case, letters and digits), and
    which texts have any."""
    out, some = np.zeros((len(texts), 2), _U), np.zeros(len(texts), bool)
    for a, b in batches(texts, 400_000):
        t = Tokens([(x or "").lower() for x in texts[a:b]], NOT_WORD)
        lists = [np.unique(t.hash[i:j]) for i, j in zip(t.first[:-1], t.first[1:])]
        n = np.array([len(x) for x in lists])
        full = np.flatnonzero(n)
        if not len(full):
            continue
        flat = np.concatenate(lists)
        some[a + full] = True
        for word, h in enumerate((flat, mix(flat ^ _SECOND))):
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
            out[a + full, word] = np.packbits(2 * sums > n[full, None], axis=1, bitorder="little").view(_U)[:, 0]
    return out, some


def names(x: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row of two words."""
    return mix(x[:, 0] ^ mix(x[:, 1] + _SECOND))


def rotate(x: np.ndarray, bits: int) -> np.ndarray:
    """Rows of two words turned left."""
    bits %= BITS
    if bits >= WORD:
        x, bits = x[:, ::-1], bits - WORD
    if not bits:
        return x
    up, down = _U(bits), _U(WORD - bits)
    return np.stack([(x[:, 0] << up) | (x[:, 1] >> down), (x[:, 1] << up) | (x[:, 0] >> down)], 1)


def ordered(x: np.ndarray) -> np.ndarray:
    """Distinct rows, in order."""
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    return x[np.append(True, (x[1:] != x[:-1]).any(axis=1))[: len(x)]]


def trie_join(a: np.ndarray, b: np.ndarray, depth: int, budget: int, block: int, block_budget: int, leaf: int = 512):
    """Index pairs (i of a, j of b) of ordered rows with at most budget differing bits.

    a and b are each all below one node at depth. Pairs of nodes are traversed together, level by level: the
    children's differing bits accumulate, and a pair is pruned beyond block_budget within the first block bits or
    beyond budget at all. Pairs of few rows, or below the first word, are compared directly. If a is b, each pair comes
    once. Yields arrays.
    """
    same = a is b
    x, y = a[:, 0].copy(), b[:, 0].copy()
    start = int(np.bitwise_count((x[0] ^ y[0]) >> _U(WORD - depth))) if depth else 0
    stack = [(depth, *(np.array([v]) for v in (0, len(a), 0, len(b), start)))]
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > 500_000:  # depth first by halves: bounds memory
            h = len(al) // 2
            stack += [(d, *(v[:h] for v in (al, ah, bl, bh, err))), (d, *(v[h:] for v in (al, ah, bl, bh, err)))]
            continue
        small = ((ah - al) * (bh - bl) <= leaf) | (d == WORD)
        if small.any():
            n, m = (ah - al)[small], (bh - bl)[small]
            for part in np.array_split(np.arange(len(n)), max(1, int((n * m).sum()) // 2_000_000)):
                i = np.repeat(ranges(al[small][part], n[part]), np.repeat(m[part], n[part]))
                j = ranges(np.repeat(bl[small][part], n[part]), np.repeat(m[part], n[part]))
                ok = np.bitwise_count(x[i] ^ y[j]) <= budget
                if same:
                    ok &= i < j
                i, j = i[ok], j[ok]
                ok = np.bitwise_count(a[i] ^ b[j]).sum(axis=1) <= budget
                if ok.any():
                    yield i[ok], j[ok]
        al, ah, bl, bh, err = (v[~small] for v in (al, ah, bl, bh, err))
        if not len(al):
            continue
        am, bm = (_middle(v, lo, hi, d) for v, lo, hi in ((x, al, ah), (y, bl, bh)))
        most = block_budget if d + 1 <= block else budget
        one = (al == bl) & (ah == bh) if same else np.zeros(len(al), bool)
        made = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), tuple(v[~one] for v in (am, ah, bl, bm, err + 1))]
        al, ah, bl, bh, err = (np.concatenate(v) for v in zip(*made))
        live = (al < ah) & (bl < bh) & (err <= most)
        if live.any():
            stack.append((d + 1, *(v[live] for v in (al, ah, bl, bh, err))))


def _middle(x: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the child with bit 1 at depth begins in each node's range."""
    shift = _U(WORD - 1 - depth)
    return np.clip(np.searchsorted(x, ((x[low] >> shift) | _ONE) << shift), low, high)


def block_budgets(budget: int, blocks: int) -> list[int]:
    """Differing bits allowed in each block. They sum to budget - blocks + 1: if every block had more than its own, the
    whole would have more than budget, so that a near pair keeps within some block's. -1: a block that isn't needed."""
    total = budget - blocks + 1
    return [total // blocks + (k < total % blocks) for k in range(blocks)]


def near_edges(hashes: DataFrame, budget: int = 16, blocks: int = 6, node_size: int = 500_000) -> DataFrame:
    """Edges (a, b) between names of distinct SimHashes (hi, lo) that join all pairs of at most budget differing bits.

    There is a trie for each of 6 blocks of 21 bits, with the block turned to the front: it prunes beyond 2 (in the last
    1) differing bits in that block and beyond budget after it, and no near pair is lost in all of them. A task joins two
    nodes of prefix bits and sends a star for each component it finds, not all pairs.
    """
    count = hashes.select("hi", "lo").distinct().count()
    width, allowed = BITS // blocks, block_budgets(budget, blocks)
    prefix = min(width, max(3, math.ceil(math.log2(max(1, count / node_size)))))
    near_nodes = {part: _masks(prefix, part) for part in set(allowed) if part >= 0}

    def nodes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            h = ordered(np.stack([r.column(c).to_numpy().view(_U) for c in ("hi", "lo")], 1))
            for turn, part in enumerate(allowed):
                if part < 0 or not len(h):
                    continue
                x = ordered(rotate(h, turn * width))
                top = (x[:, 0] >> _U(WORD - prefix)).astype(np.int64)
                for node, at, size in zip(*np.unique(top, return_index=True, return_counts=True)):
                    own = x[at : at + size]
                    near = near_nodes[part] ^ int(node)
                    n = len(near)
                    keys, rest = pack(np.ascontiguousarray(own[:, 0])), own[:, 1].tobytes()
                    yield pa.record_batch(
                        [pa.array([turn] * n, pa.int32()), pa.array(np.minimum(near, node), pa.int64()), pa.array(np.maximum(near, node), pa.int64()), pa.array([int(node)] * n, pa.int64()), pa.array([keys] * n, pa.binary()), pa.array([rest] * n, pa.binary())],
                        names=["turn", "low", "high", "node", "keys", "rest"],
                    )

    def join(t: pa.Table) -> pa.Table:
        turn, low, high = (t.column(c)[0].as_py() for c in ("turn", "low", "high"))
        side = {low: [], high: []}
        for node, keys, rest in zip(*(t.column(c).to_pylist() for c in ("node", "keys", "rest"))):
            side[node].append(np.stack([unpack(keys), np.frombuffer(rest, _U)], 1))
        if not side[low] or not side[high]:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x = ordered(np.concatenate(side[low]))
        y = x if low == high else ordered(np.concatenate(side[high]))
        back = [names(rotate(z, BITS - turn * width)) for z in (x, y)]
        left, right, size = [np.zeros(0, _U)], [np.zeros(0, _U)], 0
        for i, j in trie_join(x, y, prefix, budget, width, allowed[turn]):
            left.append(back[0][i])
            right.append(back[1][j])
            size += len(i)
            if size > 4_000_000:
                p, q = star(np.concatenate(left), np.concatenate(right))
                left, right, size = [p], [q], 0
        p, q = star(np.concatenate(left), np.concatenate(right))
        return pa.table({"a": p.view(np.int64), "b": q.view(np.int64)})

    return hashes.select("hi", "lo").mapInArrow(nodes, "turn int, low long, high long, node long, keys binary, rest binary").groupBy("turn", "low", "high").applyInArrow(join, "a long, b long")


def _masks(bits: int, budget: int) -> np.ndarray:
    """All numbers of bits bits of which at most budget are set."""
    out = np.arange(1 << bits)
    return out[np.bitwise_count(out) <= budget]


def _hashed(docs: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows:
            h, some = simhashes(r.column("text").to_pylist())
            out = [r.column("doc_id").cast(pa.int64()), r.column("row"), *[pa.array(x.view(np.int64)) for x in (names(h), h[:, 0].copy(), h[:, 1].copy())]]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "row", "hash", "hi", "lo"]).filter(pa.array(some))

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, hash long, hi long, lo long")


def near_groups(docs: DataFrame, budget: int = 16) -> DataFrame:
    """doc_id, row (hash of id and text), group_id, kept: rows of docs in groups of two or more near copies.

    Rows are near if their 128-bit SimHashes differ in at most budget bits (texts with 0.9 of their words in common, or
    0.85, differ in 16 or fewer 99 or 96 times of 100); a group is a connected component. group_id is
    the doc_id of the row that is kept, the least by (doc_id, row), a null doc_id last. Texts without a word (null,
    empty, marks only) are in no group. Rows equal in doc_id and text can't be told apart and are kept or not together.
    An empty table gives an empty result; other columns aren't read.
    """
    sims = table(_hashed(docs), "simhashes")
    roots = components(near_edges(sims, budget))
    g = sims.join(roots, sims.hash == roots.node, "left").select("doc_id", "row", F.coalesce("root", "hash").alias("root"))
    first = g.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row"))).alias("first"), F.count("*").alias("n")).filter("n > 1")
    out = g.join(first, "root")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    return out.select("doc_id", "row", F.col("first.doc_id").alias("group_id"), kept.alias("kept"))


def drop_near_copies(docs: DataFrame, budget: int = 16) -> DataFrame:
    """docs, all columns, with one document of each group of near_groups; rows equal in doc_id and text come once."""
    # both sides by the same three keys without nulls: the text is shuffled once for the distinct rows and the join
    keys = {"__sc_id": F.coalesce("doc_id", F.lit(0)).cast("long"), "__sc_null": F.col("doc_id").isNull()}
    gone = near_groups(docs, budget).filter("NOT kept").select(*[e.alias(k) for k, e in keys.items()], F.col("row").alias("__sc_row")).distinct()
    t = docs.withColumns(keys | {"__sc_row": F.xxhash64("doc_id", "text")}).dropDuplicates([*keys, "__sc_row"])
    return t.join(gone, [*keys, "__sc_row"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir)).select("doc_id", "group_id", "kept")


QUERIES = {"op6_simhash_near_dedup": op6_simhash_near_dedup}
ORACLES: dict[str, str] = {}
