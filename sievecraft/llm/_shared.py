"""Helpers that the training-data operators share: the shared folder, sizes and a packed key exchange."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where the session has none (tests), a new one that it keeps."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sievecraft-')}")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def table(df: DataFrame, what: str) -> DataFrame:
    """Write df once to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; any other trouble in reading it later is an error."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table() that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


# --- hashes over whole Arrow buffers -------------------------------------------------

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_BYTE_BASE, _TOKEN_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            made = []
            for base in (self.base, self.inverse):
                x = np.full(size, base, _U)
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


_BYTES, _TOKENS = _Powers(_BYTE_BASE), _Powers(_TOKEN_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits; works on a copy."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Tokens:
    """White-space tokens of many texts: 64-bit hashes, byte borders, and the token range of each text.

    A token is a maximal run of bytes that don't split: the six ASCII white-space characters do, or with NOT_WORD all
    ASCII characters but letters and digits. Null counts as "".
    """

    def __init__(self, texts: list[str | bytes | None], split: np.ndarray = SPACE):
        raw = [t.encode() if isinstance(t, str) else (t or b"") for t in texts]
        data = b"\n".join(raw) + b"\n"
        self.buf = np.frombuffer(data, np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.text_at = np.concatenate([[0], np.cumsum(sizes + 1)])  # each text's first byte, and the end
        space = split[self.buf]
        self.starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        self.ends = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        up, _ = _BYTES.get(len(self.buf) + 1)
        sums = np.zeros(len(self.buf) + 1, _U)
        np.cumsum((self.buf.astype(_U) + _U(1)) * up[:-1], out=sums[1:])
        down = _BYTES.get(len(self.buf) + 1)[1]
        self.hash = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        self.first = np.searchsorted(self.starts, self.text_at)  # token range of text i: first[i] to first[i+1]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of every window of width tokens inside one text, and its first token."""
        n = len(self.hash)
        counts = np.diff(self.first)
        at = ranges(self.first[:-1], np.maximum(counts - width + 1, 0))
        up, down = _TOKENS.get(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.hash * up[:n], out=sums[1:])
        return mix((sums[at + width] - sums[at]) * down[at]), at

    def char_at(self) -> np.ndarray:
        """For each byte border, the number of code points before it in the whole buffer."""
        return np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... count times, one after the other for all pairs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def batches(texts: list, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of about limit characters; a longer text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


# --- packed exchange ------------------------------------------------------------------
#
# A chunk (some MB of text) sends each key bucket one blob: its sorted distinct 64-bit keys, as differences
# in byte planes, so that a key costs about 5 bytes of shuffle instead of 30. The bucket answers one bit a key.


def pack(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys: count, then the byte planes of the differences, without empty high planes."""
    diff = np.diff(keys, prepend=_U(0))
    planes = diff.view(np.uint8).reshape(-1, 8)
    used = 8
    while used > 1 and not planes[:, used - 1].any():
        used -= 1
    return np.array([len(keys), used], np.int64).tobytes() + np.ascontiguousarray(planes[:, :used].T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    n, used = np.frombuffer(blob, np.int64, 2)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :used] = np.frombuffer(blob, np.uint8, n * used, 16).reshape(used, n).T
    return np.cumsum(planes.reshape(-1).view(_U))


def pack_columns(x: np.ndarray) -> bytes:
    """A uint32 matrix of one row per key, as byte planes (which compress) one after the other."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(len(x), -1).T).tobytes()


def unpack_columns(blob: bytes, rows: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(-1, rows).T).view(np.uint32)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key by its first bits: equal ranges, as many as the next power of two from buckets on."""
    bits = (buckets - 1).bit_length()
    return (keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def borders(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys have, and where each begins (and the end); work follows the keys, not the buckets."""
    of = bucket_of(keys, buckets)
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    return of[at], np.append(at, len(keys))


def chunked(docs: DataFrame, chunk_bytes: int, *columns: str) -> tuple[DataFrame, int, int]:
    """docs with only columns and a chunk number set by content, the count of chunks, and the bytes of text.

    The number depends on id and text alone, so that a repeated task makes the same chunks again.
    """
    size = total_bytes(docs)
    chunks = max(1, -(-size // chunk_bytes))
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    return docs.select(key.alias("chunk"), *columns), chunks, size


def sorted_rows(table: pa.Table) -> tuple[list, list]:
    """doc_id and text of a chunk in an order that doesn't depend on how the rows arrived."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    return [r[0] for r in rows], [r[1] for r in rows]


SENT = "chunk int, bucket int, keys binary, extra binary"
ANSWER = "chunk int, bucket int, answer binary"


def blobs(chunk: int, keys: np.ndarray, extra: np.ndarray | None, buckets: int) -> pa.Table:
    """What a chunk sends: its sorted keys (repeats allowed), with a uint32 row of extra for each or none."""
    full, at = borders(keys, buckets)
    parts = list(zip(at[:-1], at[1:]))
    return pa.table(
        {
            "chunk": pa.array([chunk] * len(full), pa.int32()),
            "bucket": pa.array(full, pa.int32()),
            "keys": pa.array([pack(keys[a:b]) for a, b in parts], pa.binary()),
            "extra": pa.array([None if extra is None else pack_columns(extra[a:b]) for a, b in parts], pa.binary()),
        }
    )


def exchange(sent: DataFrame, decide: Callable[[list[np.ndarray], list[np.ndarray] | None], list[np.ndarray]]) -> DataFrame:
    """Answers per chunk and bucket: decide gets all chunks' keys of a bucket and answers each key in uint32."""

    def answer(t: pa.Table) -> pa.Table:
        keys = [unpack(x) for x in t.column("keys").to_pylist()]
        extra = t.column("extra").to_pylist()
        found = decide(keys, None if extra[0] is None else [unpack_columns(x, len(k)) for x, k in zip(extra, keys)])
        return pa.table({"chunk": t.column("chunk").combine_chunks(), "bucket": t.column("bucket").combine_chunks(), "answer": pa.array([np.packbits(x).tobytes() if x.dtype == bool else pack_columns(x.reshape(-1, 1)) for x in found], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(answer, ANSWER)


def answers(t: pa.Table, keys: np.ndarray, buckets: int, kind: type = bool) -> np.ndarray:
    """The answer to each of a chunk's sorted keys."""
    (full, at), out = borders(keys, buckets), np.zeros(len(keys), kind)
    place = np.searchsorted(full, t.column("bucket").to_numpy())
    for i, x in zip(place.tolist(), t.column("answer").to_pylist()):
        n = at[i + 1] - at[i]
        out[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=n) if kind is bool else unpack_columns(x, n)[:, 0]
    return out


def seen_twice(keys: list[np.ndarray], _extra: object = None) -> list[np.ndarray]:
    """Which of each chunk's keys come twice or more in all."""
    merged = np.sort(np.concatenate(keys))
    twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
    return [find(twice, k)[0] for k in keys]


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def spans(tokens: Tokens, at: np.ndarray, width: int, ids: list) -> dict[str, list]:
    """Union of the windows that begin at tokens at: maximal spans per text, in its tokens and characters."""
    n = len(tokens.hash)
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    covered = np.cumsum(steps)[:n] > 0
    head = np.zeros(n + 1, bool)
    head[tokens.first[:-1][np.diff(tokens.first) > 0]] = True
    before = np.concatenate([[False], covered[:-1]])
    begin = np.flatnonzero(covered & (~before | head[:n]))
    end = np.flatnonzero(covered & (np.append(~covered[1:], True) | head[1:])) + 1
    text = np.searchsorted(tokens.first, begin, "right") - 1
    chars = tokens.char_at()
    zero = chars[tokens.text_at[text]]
    return {
        "doc_id": [ids[i] for i in text],
        "start_token": begin - tokens.first[text],
        "end_token": end - tokens.first[text],
        "start_char": chars[tokens.starts[begin]] - zero,
        "end_char": chars[tokens.ends[end - 1]] - zero,
    }


SPANS = "doc_id long, start_token int, end_token int, start_char int, end_char int"
_SPAN_TYPES = pa.schema([("doc_id", pa.int64())] + [(c, pa.int32()) for c in ("start_token", "end_token", "start_char", "end_char")])


def span_table(parts: list[dict[str, list]]) -> pa.Table:
    return pa.concat_tables([pa.table({f.name: pa.array(p[f.name], f.type) for f in _SPAN_TYPES}, _SPAN_TYPES) for p in parts] or [_SPAN_TYPES.empty_table()])
