"""Chunks of documents at paragraph, sentence or word borders, with overlap: one linear fold per text in Arrow workers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import spread

_PARAGRAPHS, _SENTENCES = re.compile(r"\n\n+"), re.compile(r"(?<=\. )")
#: Rows whose chunks go into one Arrow batch.
_ROWS = 256


def merge_segments(parts: list[str], size: int, joiner: str) -> list[str]:
    """Left fold: a part joins the open segment while the result has at most size characters. Longer parts stay whole."""
    done, open_, length = [], [], 0
    for part in parts:
        joined = len(part) + (length + len(joiner) if length else 0)
        if joined <= size:
            open_ = open_ if length else []
            open_.append(part)
            length = joined
            continue
        if length:
            done.append(joiner.join(open_))
        open_, length = [part], len(part)
    return done + [joiner.join(open_)] if length else done


def segments(text: str | None, size: int) -> list[str]:
    """Paragraphs merged up to size; what is too long is split at sentences, then at spaces, and merged again."""
    whole = (text or "").strip()
    if not whole:
        return []
    out = merge_segments(_PARAGRAPHS.split(whole), size, "\n\n")
    for split, joiner in ((_SENTENCES.split, "\n\n"), (lambda s: s.split(" "), " ")):
        out = [y for x in out for y in ([x] if len(x) <= size else merge_segments(split(x), size, joiner))]
    return out


def chunk_text(docs: DataFrame, size: int = 1000, overlap: int = 200, text: str = "text") -> DataFrame:
    """docs without text, and chunk_index, total_chunks, chunk: each but the first begins with the last overlap characters
    of the segment before it. Blank and null texts have no chunks."""
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*[f"`{c}`" for c in keep]).schema.add("chunk_index", "integer").add("total_chunks", "integer").add("chunk", "string")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                row, index, total, chunk = [], [], [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    cut = segments(t, size)
                    row += [i] * len(cut)
                    index += range(len(cut))
                    total += [len(cut)] * len(cut)
                    chunk += cut[:1] + [x[-overlap:] + y if overlap > 0 else y for x, y in zip(cut, cut[1:])]
                columns = [part.column(c).take(pa.array(row, pa.int64())) for c in keep]
                yield pa.record_batch([*columns, pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(chunk, pa.string())], names=schema.names)

    return spread(docs).mapInArrow(run, schema)
