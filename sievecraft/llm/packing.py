"""Best-fit packing in bulk-synchronous rounds over documents and gaps that are range-sorted by size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, drop_table, table

#: Rows (of documents and gaps) that a range of a round's sweep aims at.
RANGE_ROWS = 200_000
#: Bounds what the driver plans from: two counts and two segments for each range and for each size.
MOST_RANGES = 50_000


def n_words(text: Column) -> Column:
    """White-space tokens of a text, null as none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r\f\x0b]+")), F.lit(0))


class Sweep:
    """Successor sweep over rows (size, is a gap, number) of one range, from large to small, gaps before pieces of their size.

    Open gaps are a stack, the smallest on top: a piece takes the top one, the smallest gap that holds it, so of
    pieces that want the same gap the first by rank (larger, then lower number) gets it and the next takes the
    next larger one. A gap takes one piece a round, or several of equal size while it still holds another.
    run() yields piece, bin, the place in the bin's sequence of this round. Pieces that no gap of this range holds are left in
    pieces, gaps that stay open in gaps (both in order), the gap in use at the end in last: the ranges of larger sizes go on from there.
    """

    def __init__(self):
        self.gaps: list[tuple[int, int]] = []  # size, number
        self.pieces: list[tuple[int, int]] = []
        self.last = (-1, 0, 0, 0)  # size of the pieces that the current gap takes, its bin, what is left, how many it took

    def run(self, rows: Iterator[tuple[int, bool, int]]) -> Iterator[tuple[int, int, int]]:
        for size, gap, number in rows:
            if gap:
                self.gaps.append((size, number))
                continue
            _, bin_, left, took = self.last
            if self.last[0] == size and left >= size:
                self.last = (size, bin_, left - size, took + 1)
            elif self.gaps:
                room, bin_ = self.gaps.pop()
                self.last = (size, bin_, room - size, 0)
            else:
                self.pieces.append((size, number))
                self.last = (-1, 0, 0, 0)
                continue
            yield number, self.last[1], self.last[3]


def across(summary: dict[tuple[int, int, int], int], last: dict[int, tuple[int, int, int, int]], ranges: int) -> list[tuple]:
    """The same sweep over what the ranges left, by counts only.

    summary: (kind, range, size) to the count of unmatched pieces (1) and open gaps (2); last: by range (size, bin, left, took).
    In each range the pieces left come before the gaps left. Yields segments: pieces of (range, size) ranked from first
    to end take per pieces each the gaps of (gap range, gap size) from rank top downwards, beginning at place skip
    of the first; with gap range -1 top is a bin and skip the place there.
    """
    kinds: dict[int, dict[int, list[tuple[int, int]]]] = {1: {}, 2: {}}
    for (kind, r, size), n in summary.items():
        kinds[kind].setdefault(r, []).append((size, n))
    stack: list[list[int]] = []  # range, size, gaps left
    out = []
    now: tuple | None = None  # size of the pieces that the current gap takes, pieces it still takes, (range, size, top, per, skip)
    for r in range(ranges):
        for size, n in sorted(kinds[1].get(r, ()), reverse=True):
            done = 0
            if now and now[0] == size and now[1]:
                k = min(n, now[1])
                g, room, top, per, skip = now[2]
                out.append((r, size, 0, k, g, room, top, per, skip))
                now, done = (size, now[1] - k, (g, room, top, per, skip + k)), k
            while done < n and stack:
                g, room, m = stack[-1]
                per = room // size
                gaps = min(m, -(-(n - done) // per))
                k = min(n - done, gaps * per)
                out.append((r, size, done, done + k, g, room, m - 1, per, 0))
                done += k
                now = (size, gaps * per - k, (g, room, m - gaps, per, per - (gaps * per - k)))
                stack[-1][2] -= gaps
                if not stack[-1][2]:
                    stack.pop()
        if r in last:
            size, bin_, left, took = last[r]
            if size:  # the range's last piece went to a gap of its own
                now = (size, left // size, (-1, 0, bin_, 1 << 30, took + 1))
        stack += [[r, size, n] for size, n in sorted(kinds[2].get(r, ()), reverse=True)]
    return out


def pack(docs: DataFrame, capacity: int = 2048, size: Column | None = None) -> DataFrame:
    """bin, slot, doc_id, piece, n_tokens: every document's tokens in bins of capacity tokens.

    A document longer than capacity is cut into pieces, all but the last full. Full pieces are bins of their own;
    the others go through rounds. Each round range-sorts unplaced pieces and open gaps by size, sweeps each range
    for successors, goes on across ranges by counts of what they left (so that the ranges don't change the result),
    updates the gaps and repeats; a round that places nothing is an error. Pieces that no gap anywhere can hold open bins: as
    many as their sum needs, for the largest of them. No piece opens a bin while a gap could hold it when the
    round began. slot orders the pieces in a bin.

    size: tokens of a row, white-space tokens of text if None. Rows of 0 tokens (null and empty texts) are in
    no bin. Each repeated row is packed by itself; a null doc_id is packed like any other; an empty table gives an
    empty result; other columns aren't read. Which of equal-sized pieces goes where is arbitrary, but set once the
    pieces are written.
    """
    n = (n_words(F.col("text")) if size is None else size).cast("int")
    sized = docs.select("doc_id", n.alias("n")).filter("n > 0")
    cut = F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {capacity} as int)"))
    pieces = sized.select("doc_id", "n", F.explode(cut).alias("piece")).select("doc_id", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).alias("size"))
    pieces = table(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")

    # bins are numbered by the piece that opened them
    full = pieces.filter(F.col("size") == capacity).select("number", F.col("number").alias("bin"), F.lit(0).alias("round"), F.lit(0).alias("place"))
    placed = [full]
    todo = pieces.filter(F.col("size") < capacity).select("number", "size")
    gaps = todo.sparkSession.createDataFrame([], "number long, size int")
    turn = 0
    while True:
        turn += 1
        stat = gaps.agg(F.max("size"), F.count("*"), F.min("size")).first()
        widest, n_gaps = stat[0] or 0, stat[1]
        fit, count, total, smallest = todo.agg(F.count_if(F.col("size") <= widest), F.count("*"), F.sum("size"), F.min("size")).first()
        if not count:
            break
        opened = None
        if fit < count:
            big = todo.filter(F.col("size") > widest)
            need = -(-int(big.agg(F.sum("size")).first()[0]) // capacity)
            opened = _largest(big, need).select("number", F.col("number").alias("bin"), F.lit(turn).alias("round"), F.lit(0).alias("place"), "size")
            opened = table(opened, "opened-bins")
            placed.append(opened.select("number", "bin", "round", "place"))
        rows = gaps.filter(F.col("size") >= smallest).select("size", F.lit(True).alias("gap"), "number").unionByName(todo.select("size", F.lit(False).alias("gap"), "number"))
        ranges = min(MOST_RANGES, max(1, (n_gaps + count) // RANGE_ROWS))

        matched = _matched(rows, ranges, turn) if n_gaps and fit else None
        if matched is not None:
            placed.append(matched)
        old_todo, old_gaps = todo, gaps
        new = [x for x in (matched, opened) if x is not None]
        if opened is None and not matched.head(1):
            raise RuntimeError("a round placed nothing")
        gone = new[0].select("number") if len(new) == 1 else new[0].select("number").union(new[1].select("number"))
        if matched is not None:
            used = matched.join(todo, "number").groupBy("bin").agg(F.sum("size").alias("used"))
            gaps = gaps.join(used, gaps.number == used.bin, "left").select("number", (F.col("size") - F.coalesce("used", F.lit(0))).cast("int").alias("size"))
        if opened is not None:
            gaps = gaps.union(opened.select("bin", (F.lit(capacity) - F.col("size")).cast("int")))
        gaps = table(gaps.filter("size > 0"), "gaps")
        todo = table(todo.join(gone, "number", "left_anti"), "unplaced")
        if turn > 1:
            drop_table(old_todo)
            drop_table(old_gaps)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    slots = F.row_number().over(_by_bin()) - 1
    return out.join(pieces, "number").select("bin", slots.alias("slot"), "doc_id", "piece", F.col("size").alias("n_tokens"))


def _by_bin():
    from pyspark.sql import Window

    return Window.partitionBy("bin").orderBy("round", "place", "number")


def _largest(rows: DataFrame, n: int) -> DataFrame:
    """n rows of the largest sizes, without a sort: sizes are counted, and only the border size is cut by number."""
    sizes = sorted(((r[0], r[1]) for r in rows.groupBy("size").count().collect()), reverse=True)  # at most capacity rows
    left = n
    for size, count in sizes:
        if count >= left:
            edge = rows.filter(F.col("size") == size).orderBy("number").limit(left) if count > left else rows.filter(F.col("size") == size)
            return rows.filter(F.col("size") > size).union(edge)
        left -= count
    return rows


_SWEPT = "kind int, number long, bin long, place int, range int, size int, rank int"
_SEGMENT = "range int, size int, first int, end int, gap_range int, gap_size int, top long, per int, skip int"


def _matched(rows: DataFrame, ranges: int, turn: int) -> DataFrame:
    """number, bin, round, place of a round: each range sweeps its rows, then what is left is matched across ranges."""

    def match(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, bool, int]]:
            for r in batch:
                yield from zip(*(r.column(c).to_pylist() for c in ("size", "gap", "number")))

        def out(kind: int, number=(), bin=(), place=(), size=(), rank=()) -> pa.RecordBatch:
            n = max(len(number), len(size))
            pad = lambda x, t: pa.array(list(x) or [0] * n, t)
            long, int_ = pa.int64(), pa.int32()
            return pa.record_batch([pad([kind] * n, int_), pad(number, long), pad(bin, long), pad(place, int_), pad([here] * n, int_), pad(size, int_), pad(rank, int_)], names=[c.split()[0] for c in _SWEPT.split(", ")])

        here = TaskContext.get().partitionId()
        sweep, found = Sweep(), []
        for x in sweep.run(each()):
            found.append(x)
            if len(found) == 100_000:
                yield out(0, *zip(*found))
                found = []
        if found:
            yield out(0, *zip(*found))
        for kind, left in ((1, sweep.pieces), (2, sweep.gaps)):
            ranks, before = [], (0, 0)
            for size, _ in left:  # rank among those of equal size
                before = (size, before[1] + 1 if before[0] == size else 0)
                ranks.append(before[1])
            for i in range(0, len(left), 100_000):
                part = left[i : i + 100_000]
                yield out(kind, [x for _, x in part], size=[x for x, _ in part], rank=ranks[i : i + 100_000])
        size, bin_, room, took = sweep.last
        yield out(3, [room], [bin_], [took], [max(size, 0)])

    order = [F.col("size").desc(), F.col("gap").desc(), F.col("number")]
    swept = table(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(match, _SWEPT), "matches")
    placed = swept.filter("kind = 0").select("number", "bin", F.lit(turn).alias("round"), "place")
    if ranges == 1:
        return placed
    counts = {(r[0], r[1], r[2]): r[3] for r in swept.filter("kind IN (1, 2)").groupBy("kind", "range", "size").count().collect()}
    last = {r["range"]: (r["size"], r["bin"], r["number"], r["place"]) for r in swept.filter("kind = 3").collect()}
    segments = across(counts, last, ranges)
    if not segments:
        return placed
    s = F.broadcast(placed.sparkSession.createDataFrame(segments, _SEGMENT))
    left = swept.filter("kind = 1").select("number", "range", "size", "rank")
    left = left.join(s, ["range", "size"]).filter("rank >= first AND rank < end").withColumn("at", F.col("rank") - F.col("first") + F.col("skip"))
    one = F.col("gap_range") < 0
    left = left.select("number", "gap_range", "gap_size", F.when(one, F.col("top")).otherwise(F.col("top") - F.expr("at div per")).alias("gap_rank"), F.when(one, F.col("at")).otherwise(F.col("at") % F.col("per")).cast("int").alias("place"))
    gaps = swept.filter("kind = 2").select(F.col("number").alias("bin"), F.col("range").alias("gap_range"), F.col("size").alias("gap_size"), F.col("rank").cast("long").alias("gap_rank"))
    far = left.filter("gap_range >= 0").join(gaps, ["gap_range", "gap_size", "gap_rank"]).select("number", "bin", "place").union(left.filter("gap_range < 0").select("number", "gap_rank", "place"))
    return placed.union(table(far.select("number", "bin", F.lit(turn).alias("round"), "place"), "matches"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLES: dict[str, str] = {}
