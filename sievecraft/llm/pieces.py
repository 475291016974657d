"""SentencePiece encoding and decoding by vectorised merge rounds over flat numpy symbol arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from importlib.util import find_spec
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents, mix, ranges

_U = np.uint64
_NONE = np.int32(2**31 - 1)
#: Segments, each after a space that stands for the word mark: more spaces and what follows them.
_SEGMENT = re.compile(r"(?: ( *[^ ]+)| ( *)$)")


def default_model() -> str:
    return str(Path(find_spec("public_tokenizers").origin).parent / "piece_bpe_32k.model")


class PieceModel:
    """A BPE model of SentencePiece with byte fallback, identity normalisation and a dummy prefix.

    Pairs of pieces are kept in one open-addressed table: (left, right) gives the merged piece. A piece's rank
    is its place by score, best first, so that the least rank is the best merge.
    """

    def __init__(self, path: str):
        import sentencepiece as sp

        m = sp.SentencePieceProcessor(model_file=path)
        size = m.vocab_size()
        pieces = [m.id_to_piece(i) for i in range(size)]
        special = np.array([m.is_control(i) or m.is_unknown(i) or m.is_byte(i) for i in range(size)])
        self.unknown = m.unk_id()
        self.size = size
        plain = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any("▁" in p.lstrip("▁") for p in plain):
            raise ValueError("pieces with a word mark inside aren't supported")
        order = sorted(plain.values(), key=lambda i: (-m.get_score(i), i))
        self.rank = np.full(size, _NONE, np.int32)
        self.rank[order] = np.arange(len(order))
        self.by_rank = np.array(order, np.int32)
        self.chars = {(" " if p == "▁" else p): i for p, i in plain.items() if len(p) == 1}
        self.bytes = np.array([next((i for i in range(size) if m.is_byte(i) and pieces[i] == f"<0x{b:02X}>"), self.unknown) for b in range(256)], np.int32)
        # code point to piece id, or -1
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in self.chars.items():
            self.of_char[ord(c)] = i
        raw = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else b"" if special[i] else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        pairs = [(plain[p[:k]], plain[p[k:]], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        key = np.array([(a << 32) | b for a, b, _ in pairs], _U)
        self._table(key, self.rank[[i for *_, i in pairs]])
        # pieces that some pair turns into one of better rank: after such a merge, its word's next merge may be beside it
        self.recalls, self.longest = np.zeros(len(order), bool), max(map(len, plain))
        for a, b, i in pairs:
            for part in (a, b):
                if self.rank[i] < self.rank[part]:
                    self.recalls[self.rank[part]] = True

    def _table(self, key: np.ndarray, value: np.ndarray) -> None:
        bits = max(4, int(len(key)).bit_length() + 3)
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.slots, self.values = np.full(1 << bits, ~_U(0)), np.full(1 << bits, _NONE, np.int32)
        self.probes = 1
        for k, v in zip(key, value):
            at = int(mix(np.array([k], _U))[0] >> self.shift)
            n = 1
            while self.slots[at] != ~_U(0):
                at, n = (at + 1) & self.mask, n + 1
            self.slots[at], self.values[at] = k, v
            self.probes = max(self.probes, n)

    def merge_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the piece that each pair makes, or _NONE."""
        key = (left.astype(_U) << _U(32)) | right.astype(_U)
        at = (mix(key) >> self.shift).astype(np.int64)
        found = np.full(len(key), _NONE, np.int32)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            slot = self.slots[at]
            hit = slot == key[open_]
            found[open_[hit]] = self.values[at[hit]]
            more = ~hit & (slot != ~_U(0))
            if not more.any():
                break
            open_, at = open_[more], (at[more] + 1) & self.mask
        return found

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a text's characters, and each one's UTF-8 bytes where it has no piece (-1 as id)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.of_char[points], points

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids and the count for each word; a word's mark is a space in it.

        Each round merges all pairs of a word that have its best rank, from left to right without overlap; if the piece that
        they make can be part of a pair of better rank, only the leftmost of those that merges beside it may reach (no piece is
        longer than longest). Both equal one merge at a time, best rank first and leftmost of equal ones, and the rounds
        depend on the ranks that a word holds rather than on its length.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        syms, points = self.symbols("".join(words))
        word, place = np.repeat(np.arange(len(words)), sizes), np.arange(len(syms))
        done_ids, done_place, done_word = [], [], []
        # rank of the pair that begins at each symbol; the last of a word has none
        rank = np.full(len(syms), _NONE, np.int32)
        pair = np.flatnonzero((word[1:] == word[:-1]) & (syms[1:] >= 0) & (syms[:-1] >= 0)) if len(syms) else np.zeros(0, int)
        rank[pair] = self.merge_ranks(syms[pair], syms[pair + 1])
        while len(syms):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, heads)
            live = best < _NONE
            if not live.all():
                # words without a pair are finished: compaction takes them out
                count = np.diff(np.append(heads, len(syms)))
                stay = np.repeat(live, count)
                done_ids.append(syms[~stay])
                done_place.append(place[~stay])
                done_word.append(word[~stay])
                syms, place, word, rank = syms[stay], place[stay], word[stay], rank[stay]
                if not len(syms):
                    break
                heads, best = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])), best[live]
            count = np.diff(np.append(heads, len(syms)))
            hits = np.flatnonzero(rank == np.repeat(best, count))
            # every second of hits that overlap in a row; or the first after a gap that no merge beside it can bridge
            new = np.concatenate([[True], word[hits][1:] != word[hits][:-1]])
            row = np.flatnonzero(new | np.concatenate([[True], hits[1:] != hits[:-1] + 1]))
            nth = np.arange(len(hits)) - np.repeat(row, np.diff(np.append(row, len(hits))))
            far = new | np.concatenate([[True], np.diff(hits) > 2 * self.longest])
            at = hits[np.where(self.recalls[rank[hits]], far, nth % 2 == 0)]
            syms[at] = self.by_rank[rank[at]]
            gone = np.ones(len(syms), bool)
            gone[at + 1] = False
            rank[at] = _NONE
            syms, place, word, rank = syms[gone], place[gone], word[gone], rank[gone]
            at -= np.arange(len(at))  # one symbol before each went, in each earlier word
            for i in (at[at > 0] - 1, at[at + 1 < len(syms)]):
                same = word[i] == word[i + 1]
                rank[i[~same]] = _NONE
                i = i[same]
                ok = (syms[i] >= 0) & (syms[i + 1] >= 0)
                rank[i] = _NONE
                rank[i[ok]] = self.merge_ranks(syms[i[ok]], syms[i[ok] + 1])
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        out, place, word = map(np.concatenate, (done_ids, done_place, done_word))
        order = np.argsort(place, kind="stable")
        out, place, word = out[order], place[order], word[order]
        bad = np.flatnonzero(out < 0)
        if len(bad):  # bytes in place of characters without a piece
            raw = [np.frombuffer(chr(points[p]).encode("utf-8", "surrogatepass"), np.uint8) for p in place[bad]]
            n = np.ones(len(out), np.int64)
            n[bad] = [len(r) for r in raw]
            at = np.cumsum(n) - n
            full = np.repeat(out, n)
            full[ranges(at[bad], n[bad])] = self.bytes[np.concatenate(raw)]
            out, word = full, np.repeat(word, n)
        return out, np.bincount(word, minlength=len(words))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of flat ids with so many for each; the dummy prefix is taken off, broken UTF-8 replaced."""
        size = self.raw_len[ids]
        data = self.raw[ranges(self.raw_at[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        out = []
        for a, b in zip(ends[:-1], ends[1:]):
            t = data[a:b]
            out.append((t[1:] if t[:1] == b" " else t).decode("utf-8", "replace"))
        return out


class Encoder:
    """Texts to ids, with the words met so far kept (words, not texts: up to limit of them)."""

    def __init__(self, model: PieceModel, limit: int = 400_000):
        self.model, self.limit = model, limit
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the count for each."""
        if len(self.at) > self.limit:
            self._reset()
        words = [_words(t) for t in texts]
        new = list(set().union(*words).difference(self.at)) if words else []
        if new:
            ids, n = self.model.encode_words([" " + w for w in new])
            self.at.update(zip(new, range(len(self.start), len(self.start) + len(new))))
            self.start = np.concatenate([self.start, np.cumsum(n) - n + len(self.ids)])
            self.count = np.concatenate([self.count, n])
            self.ids = np.concatenate([self.ids, ids])
        total = sum(map(len, words))
        at = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), np.int64, total)
        n = self.count[at]
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        return self.ids[ranges(self.start[at], n)], np.bincount(owner, n, len(texts)).astype(np.int64)


def _words(text: str | None) -> list[str]:
    """The text's segments without the space before each; "" and null have none."""
    if not text:
        return []
    if "▁" in text:
        text = text.replace("▁", " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [a or b for a, b in _SEGMENT.findall(" " + text)]


@lru_cache(2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


ENCODED = "doc_id long, n_pieces int, ids array<int>, round_trip boolean"


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, and whether decoding gives the text again, for every row of docs.

    ids equal those of the model's own library. round_trip is false only for texts that hold the word mark
    U+2581, which stands for a space. Null texts give null in all but doc_id; empty ones no ids. Repeated rows
    are each returned; an empty table gives an empty result; other columns aren't read. Nothing is shuffled.
    """
    path = model or default_model()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path)
        enc = Encoder(m)
        for b in rows:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                flat, n = enc.encode(part)
                null = np.array([t is None for t in part])
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                same = [x == t for x, t in zip(m.decode(flat, n), part)]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(null))
                yield pa.record_batch([ids.slice(i, len(part)).cast(pa.int64()), pa.array(n.astype(np.int32), mask=null), lists, pa.array(same, pa.bool_(), mask=null)], names=["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text for every row of encoded (doc_id, ids): the text that the pieces stand for.

    The mark that encoding puts before a text is taken off; bytes that aren't UTF-8 become U+FFFD. Null ids give a
    null text, no ids an empty one; repeated rows are each returned; an empty table gives an empty result; other
    columns aren't read; an id outside the vocabulary is an error. Nothing is shuffled.
    """
    path = model or default_model()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(path)
        for b in rows:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lists = part.column("ids").to_pylist()
                flat = np.fromiter(chain.from_iterable(x or () for x in lists), np.int64)
                texts = m.decode(flat, np.array([len(x or ()) for x in lists], np.int64))
                null = np.array([x is None for x in lists], bool)
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string(), mask=null)], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir))


def sentencepiece_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_documents(encode_documents(documents(spark, sf_dir)))


QUERIES = {"op10_sentencepiece": op10_sentencepiece, "sentencepiece_decode": sentencepiece_decode}
ORACLES = {"sentencepiece_decode": "SELECT doc_id, replace(text, '▁', ' ') AS text FROM documents"}
