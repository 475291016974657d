"""Label balance, diversity and evaluation metrics."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..storage import spread
from .report import StepReport

#: Rows by seq that one window of a token stream takes; the stream is stitched together at the borders.
BLOCK = 10_000


def label_distribution(samples: DataFrame, label: str = "label") -> DataFrame:
    """label, n, share of the labelled rows; null labels don't count. first_seq breaks ties of count."""
    return _shares(samples.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")))


def _shares(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("label", "n", (F.col("n") / F.col("total")).alias("share"), "first_seq")


def entity_distribution(samples: DataFrame, entities: str = "entities") -> DataFrame:
    """label, n over all entities; one without a label counts as unknown."""
    each = samples.select(F.explode(entities).alias("e"))
    return each.groupBy(F.coalesce("e.label", F.lit("unknown")).alias("label")).agg(F.count("*").alias("n"))


def entropy(n: Column) -> Column:
    """Aggregate: Shannon entropy in bits of a column of counts: log2 N - sum(n log2 n) / N."""
    return F.coalesce(F.round(F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n), 4), F.lit(0.0))


def length_stats(samples: DataFrame, text: str = "text") -> DataFrame:
    """mean, min, max and sample standard deviation of text lengths; 0 for none."""
    n = F.length(text)
    return samples.agg(
        F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("mean"),
        F.coalesce(F.min(n), F.lit(0)).alias("min"),
        F.coalesce(F.max(n), F.lit(0)).alias("max"),
        F.coalesce(F.round(F.stddev_samp(n), 1), F.lit(0.0)).alias("std"),
    )


def vocabulary(samples: DataFrame, text: str = "text") -> DataFrame:
    """vocabulary_size, total_tokens, type_token_ratio of white-space tokens."""
    each = spread(samples.select(text)).select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    t = each.agg(F.count("*").alias("vocabulary_size"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_tokens"))
    return t.withColumn("type_token_ratio", F.when(F.col("total_tokens") > 0, F.round(F.col("vocabulary_size") / F.col("total_tokens"), 4)).otherwise(0.0))


def _border(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams that cross blocks, from each block's first and last two tokens in the order of blocks."""
    carry: list[str] = []
    made: list[tuple[int, str]] = []
    for batch in rows:
        for head, tail, count in zip(*(batch.column(c).to_pylist() for c in ("head", "tail", "count"))):
            for n in (2, 3):
                line = carry[-(n - 1) :] + head[: n - 1]
                left = min(len(carry), n - 1)
                made += [(n, " ".join(line[i : i + n])) for i in range(len(line) - n + 1) if i < left < i + n]
            carry = (carry + tail)[-2:] if count < 2 else tail
    yield pa.record_batch([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.string())], names=["n", "gram"])


_BLANKS = r"\s\x1c-\x1f"
_ENDS = rf"(?U)^[{_BLANKS}]*([^{_BLANKS}]+)(?:[{_BLANKS}]+([^{_BLANKS}]+))?"
_U = np.uint64
#: Keys of n-grams of one length, in a bucket of their range: c of them were counted. keys has 8 bytes of each, then 4 bytes of each.
_GRAM = "n int, bucket int, c long, keys binary"
#: Keys that a task packs at once.
KEYS = 1_500_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _digests(words: Iterable[str]) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    raw = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words)
    return np.frombuffer(raw, _U).reshape(-1, 2)


def _gram_keys(digests: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
    """96-bit key (two columns, the second of 32 bits) of each n-gram, given as the places of its words in digests."""
    out = np.zeros((len(grams[0]), 2), _U)
    for g in grams:
        out = _mixed(out * _U(0x9E3779B97F4A7C15) + digests[g] + _U(1))
    out[:, 1] >>= _U(32)
    return out


def _distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order."""
    order = np.argsort(high)
    h, x = high[order], low[order]
    same = h[1:] == h[:-1]
    if (same & (x[1:] != x[:-1])).any():  # keys that agree in 64 bits
        order = np.lexsort((low, high))
        h, x = high[order], low[order]
        same = (h[1:] == h[:-1]) & (x[1:] == x[:-1])
    first = np.append(True, ~same)[: len(h)]
    return h[first], x[first]


def _packed(made: Iterator[tuple[int, np.ndarray, int]], bits: int) -> Iterator[pa.RecordBatch]:
    """(n, keys, count) as rows of _GRAM, each key once in KEYS: by 2**bits ranges of keys."""
    held: dict[int, list[np.ndarray]] = {}
    total = dict.fromkeys((1, 2, 3), 0)

    def flush() -> Iterator[pa.RecordBatch]:
        for n, parts in held.items():
            keys = np.concatenate(parts)
            high, low = _distinct(keys[:, 0], keys[:, 1].astype(np.uint32))
            bucket = (high >> _U(64 - bits)).astype(np.int32) if bits else np.zeros(len(high), np.int32)
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            end = np.append(begin[1:], len(high))
            blobs = [high[i:j].tobytes() + low[i:j].tobytes() for i, j in zip(begin, end)]
            c = np.zeros(len(begin), np.int64)
            c[0], total[n] = total[n], 0
            yield pa.record_batch([pa.array(np.full(len(begin), n, np.int32)), pa.array(bucket[begin]), pa.array(c), pa.array(blobs, pa.binary())], names=["n", "bucket", "c", "keys"])

    size = 0
    for n, keys, count in made:
        held.setdefault(n, []).append(keys)
        total[n] += count
        size += len(keys)
        if size > KEYS:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def _count(t: pa.Table) -> pa.Table:
    """n, total, distinct of a bucket."""
    blobs = t.column("keys").to_pylist()
    high = np.concatenate([np.frombuffer(b, _U, len(b) // 12) for b in blobs])
    low = np.concatenate([np.frombuffer(b, np.uint32, len(b) // 12, len(b) // 12 * 8) for b in blobs])
    return pa.table({"n": t.column("n")[:1], "total": pa.array([sum(t.column("c").to_pylist())], pa.int64()), "distinct": pa.array([len(_distinct(high, low)[0])], pa.int64())})


def _inside(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """n, keys of the different n-grams inside the texts of up to 512 rows, and how many n-grams there are."""
    for batch in rows:
        for at in range(0, batch.num_rows, 512):
            lists = [t.lower().split() for t in batch.column(0).slice(at, 512).to_pylist() if t]
            places: dict[str, int] = {}
            flat = np.fromiter((places.setdefault(w, len(places)) for x in lists for w in x), np.int64)
            digests, size = _digests(places), len(places)
            last = np.zeros(len(flat), bool)
            last[np.cumsum([len(x) for x in lists if x], dtype=np.int64) - 1] = True
            grams, names, inside = [flat], flat, np.ones(len(flat), bool)
            for n in (1, 2, 3):
                if n > 1:
                    # names of shorter n-grams that occur, so that pairs of them stay below 2**63
                    found, short = np.unique(names, return_inverse=True)
                    inside = inside[:-1] & ~last[n - 2 : len(flat) - 1]
                    names, grams = short[:-1] * size + flat[n - 1 :], [*[g[: len(inside)] for g in grams], flat[n - 1 :]]
                    if not len(inside):
                        break
                _, first = np.unique(names[inside], return_index=True)
                if len(first):
                    yield n, _gram_keys(digests, [g[inside][first] for g in grams]), int(inside.sum())


def _keyed(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """The same keys for n-grams given as text."""
    for batch in rows:
        for n in (2, 3):
            grams = [g.split(" ") for k, g in zip(*(batch.column(c).to_pylist() for c in ("n", "gram"))) if k == n]
            if grams:
                digests = _digests(w for g in grams for w in g)
                yield n, _gram_keys(digests, [np.arange(len(grams)) * n + i for i in range(n)]), len(grams)


def distinct_ngrams(samples: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """n (1 to 3), total, distinct, ratio over the token stream of all texts joined in the order of seq.

    N-grams inside texts are counted in Arrow batches and shuffled as packed 96-bit keys, to be counted in buckets of their range; those that
    cross texts come from the first and last two tokens of each row, in a window per block of seq; those that cross
    blocks from one row per block, in one task.
    """
    # under a million keys a bucket, as a byte of Parquet has some 0.3 n-grams of each length
    bits = min(12, (samples.select("seq", text)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >> 21).bit_length())
    samples = samples.select("seq", text)
    inside = spread(samples.select(text)).mapInArrow(lambda rows: _packed(_inside(rows), bits), _GRAM)
    # a row's ends: first and last two tokens (the same ones if it has fewer)
    two = lambda t: F.array_compact(F.array(*[F.lower(F.nullif(F.regexp_extract(t, _ENDS, i), F.lit(""))) for i in (1, 2)]))
    turned = lambda a: F.reverse(F.transform(a, F.reverse))
    ends = samples.select("seq", two(F.col(text)).alias("head"), turned(two(F.reverse(F.col(text)))).alias("tail")).filter(F.size("head") > 0)
    ends = ends.select((F.col("seq") / block).cast("long").alias("block"), "seq", "head", "tail", F.size("head").alias("count"))
    by_block = ends.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("seq", "head", "tail", "count"))).alias("rows"))

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: dict[str, list] = {"block": [], "head": [], "tail": [], "count": [], "grams": []}
            for b, lines in zip(batch.column("block").to_pylist(), batch.column("rows").to_pylist()):
                t = pa.record_batch({"head": [x["head"] for x in lines], "tail": [x["tail"] for x in lines], "count": [x["count"] for x in lines]})
                made = next(_border(iter([t]))).to_pylist()
                head, tail = [], []
                for x in lines:
                    head += x["head"] if len(head) < 2 else []
                    if len(head) >= 2:
                        break
                for x in reversed(lines):
                    tail = x["tail"] + tail
                    if len(tail) >= 2:
                        break
                for k, v in (("block", b), ("head", head[:2]), ("tail", tail[-2:]), ("count", sum(x["count"] for x in lines)), ("grams", made)):
                    out[k].append(v)
            yield pa.record_batch({"block": pa.array(out["block"], pa.int64()), "head": pa.array(out["head"], pa.list_(pa.string())), "tail": pa.array(out["tail"], pa.list_(pa.string())), "count": pa.array(out["count"], pa.int64()), "grams": pa.array(out["grams"], pa.list_(pa.struct([("n", pa.int32()), ("gram", pa.string())])))})

    seams = by_block.mapInArrow(blocks, "block long, head array<string>, tail array<string>, count long, grams array<struct<n int, gram string>>")
    crossing = seams.select(F.inline("grams"))
    between = seams.select("block", "head", "tail", "count").repartition(1).sortWithinPartitions("block").mapInArrow(_border, "n int, gram string")
    all_ = inside.unionByName(crossing.unionByName(between).mapInArrow(lambda rows: _packed(_keyed(rows), bits), _GRAM))
    counted = all_.groupBy("n", "bucket").applyInArrow(_count, "n int, total long, distinct long").groupBy("n").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"))
    sizes = samples.sparkSession.createDataFrame([(1,), (2,), (3,)], "n int")
    out = sizes.join(counted, "n", "left").select("n", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("distinct", F.lit(0)).alias("distinct"))
    return out.withColumn("ratio", F.when(F.col("total") > 0, F.round(F.col("distinct") / F.col("total"), 4)).otherwise(0.0))


def unigram_bleu(reference: Column, hypothesis: Column) -> Column:
    """Multiset overlap of two token arrays over the hypothesis' length; 0 if either is empty."""
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(hypothesis, reference), F.lit(0), lambda s, x: s + F.least(count(reference, x), count(hypothesis, x)))
    return F.when((F.size(reference) == 0) | (F.size(hypothesis) == 0), 0.0).otherwise(shared / F.size(hypothesis))


def self_bleu(samples: DataFrame, seed: int = 42, texts: int = 100, pairs: int = 50) -> DataFrame:
    """n_pairs, self_bleu: mean BLEU of neighbours in a sample of up to texts rows; 0 under four rows.

    The sample is the feature: rows in the order of md5(seed:seq), so that a run can be repeated.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.col("seq").cast("string")))
    chosen = samples.withColumn("mark", mark).orderBy("mark", "seq").limit(texts)
    w = Window.orderBy("mark", "seq")  # at most texts rows
    all_ = Window.partitionBy()
    t = chosen.select("mark", "seq", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    t = t.withColumns({"i": F.row_number().over(w), "next": F.coalesce(F.lead("t").over(w), F.first("t").over(w)), "n": F.count("*").over(all_)})
    score = unigram_bleu(F.col("t"), F.col("next"))
    return t.filter(f"i <= {pairs} AND n >= 4").agg(F.count("*").alias("n_pairs"), F.coalesce(F.round(F.avg(score), 4), F.lit(0.0)).alias("self_bleu"))


def evaluate_dataset(samples: DataFrame, seed: int = 42) -> dict:
    """All metrics of a dataset as one nested dict; {"error": ...} if it is empty."""
    count = samples.count()
    if not count:
        return {"error": "no samples to evaluate"}
    labels = label_distribution(samples).orderBy(F.desc("n"), "first_seq").collect()  # one row per label
    n = {r["label"]: r["n"] for r in labels}
    total = sum(n.values())
    grams = {r["n"]: r["ratio"] for r in distinct_ngrams(samples).collect()}
    vocab, length = vocabulary(samples).first(), length_stats(samples).first()
    return {
        "count": count,
        "text_length": length.asDict(),
        **vocab.asDict(),
        **{f"distinct_{k}": v for k, v in grams.items()},
        "self_bleu": self_bleu(samples, seed).first()["self_bleu"],
        "num_labels": len(n),
        "label_distribution": n,
        "label_entropy": round(-sum(v / total * math.log2(v / total) for v in n.values()), 4) if n else 0.0,
    }


class DiversityReporter:
    """Passes rows on and reports distinct n-gram ratios and vocabulary."""

    name = "diversity"

    def process(self, samples: DataFrame) -> tuple[DataFrame, StepReport]:
        n = samples.count()
        if not n:
            return samples, StepReport(self.name, 0, 0, 0, 0, {"skipped": "no samples"})
        v = vocabulary(samples).first()
        details = {f"distinct_{r['n']}": r["ratio"] for r in distinct_ngrams(samples).collect()}
        return samples, StepReport(self.name, n, n, 0, 0, details | {"vocabulary_size": v["vocabulary_size"], "total_tokens": v["total_tokens"]})


def balance_report(samples: DataFrame, max_ratio: float = 3.0, label: str = "label") -> DataFrame:
    """One row: labels, min_count, max_count, ratio, imbalanced."""
    c = samples.filter(F.col(label).isNotNull()).groupBy(label).count()
    ratio = F.max("count") / F.min("count")
    return c.agg(F.count("*").alias("n_labels"), F.min("count").alias("min_count"), F.max("count").alias("max_count"), F.round(ratio, 2).alias("ratio"), F.coalesce(ratio > max_ratio, F.lit(False)).alias("imbalanced"))


def undersample(samples: DataFrame, cap: int) -> DataFrame:
    """The first cap rows of each label by seq, then the unlabelled rows; seq is kept, moved says which come last.

    Labels are ranked over (label, seq) alone, within ranges of seq first: no label's rows go to one task whole.
    """
    slim = samples.filter(F.col("label").isNotNull()).select("label", "seq")
    # the cap lowest seqs of a label are among the cap lowest of each of its parts
    part = F.pmod(F.xxhash64("seq"), F.lit(64))
    within = F.row_number().over(Window.partitionBy("label", "part").orderBy("seq"))
    first = slim.withColumn("part", part).withColumn("r", within).filter(F.col("r") <= cap)
    last = F.row_number().over(Window.partitionBy("label").orderBy("seq"))
    over = first.withColumn("r", last).filter(F.col("r") <= cap).select("seq")
    kept = samples.filter(F.col("label").isNotNull()).join(over, "seq", "left_semi")
    return kept.withColumn("moved", F.lit(False)).unionByName(samples.filter(F.col("label").isNull()).withColumn("moved", F.lit(True)))


class BalanceChecker:
    """Reports label counts; undersample caps every label at max_ratio times the rarest one."""

    name = "balance"

    def __init__(self, strategy: str = "report", max_ratio: float = 3.0):
        if strategy not in ("report", "undersample"):
            raise ValueError(f"strategy is {strategy!r}; it must be report or undersample")
        if max_ratio < 1:
            raise ValueError("max_ratio must be 1 or more")
        self.strategy, self.max_ratio = strategy, max_ratio

    def process(self, samples: DataFrame) -> tuple[DataFrame, StepReport]:
        found = {r[0]: r[1] for r in samples.groupBy("label").count().collect()}  # one row per label
        n, unlabelled = sum(found.values()), found.pop(None, 0)
        if not found:
            return samples, StepReport(self.name, n, n, 0, 0, {"skipped": "no labeled samples"})
        low, high = min(found.values()), max(found.values())
        details = {"label_counts": found, "ratio": round(high / low, 2), "imbalanced": high / low > self.max_ratio}
        if self.strategy == "report" or not details["imbalanced"]:
            return samples, StepReport(self.name, n, n, 0, 0, details)
        cap = int(low * self.max_ratio)
        after = {k: min(v, cap) for k, v in found.items()}
        out = undersample(samples, cap)
        # unlabelled rows come last: seq is renumbered beyond the others
        top = samples.agg(F.max("seq")).first()[0] + 1
        out = out.withColumn("seq", F.col("seq") + F.when(F.col("moved"), top).otherwise(0)).drop("moved")
        kept = sum(after.values()) + unlabelled
        return out, StepReport(self.name, n, kept, n - kept, 0, details | {"cap_per_label": cap, "label_counts_after": after})
