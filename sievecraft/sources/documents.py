"""Document loaders: text, Markdown, HTML and PDF files as chunks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunk_text
from ..storage import spread

logger = logging.getLogger(__name__)
CHUNK_COLUMNS = ("text", "source", "page", "chunk_index", "total_chunks")


class _Text(HTMLParser):
    """Text nodes outside of script and style."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style") and self.hidden is None:
            self.hidden = tag

    def handle_endtag(self, tag: str) -> None:
        if tag == self.hidden:
            self.hidden = None

    def handle_data(self, data: str) -> None:
        if self.hidden is None and data.strip():
            self.parts.append(data.strip())


def html_text(html: str | None) -> str | None:
    """Stripped text nodes that aren't blank, a blank line between them."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return "\n\n".join(p.parts)


def extract_html(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages with the text of html in out. Columns that aren't used later are pruned before the Python worker."""
    schema = pages.drop(html).schema.add(out, "string")
    names = [c for c in pages.columns if c != html]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for at in range(0, whole.num_rows, 64):  # pages as Python strings take several times their size
                b = whole.slice(at, 64)
                text = pa.array([html_text(x) for x in b.column(html).to_pylist()], pa.string())
                yield pa.record_batch([*[b.column(c) for c in names], text], names=[*names, out])

    return spread(pages).mapInArrow(run, schema)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, as Latin-1 elsewhere."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def _text(files: DataFrame) -> DataFrame:
    return files.select("source", F.lit(None).cast("int").alias("page"), decoded(F.col("content")).alias("text"))


def _html(files: DataFrame) -> DataFrame:
    return extract_html(_text(files).withColumnRenamed("text", "html"))


def _pdf(files: DataFrame) -> DataFrame:
    """Pages from 1, blank ones left out. A file that can't be opened has none."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise ImportError("reading PDF files needs PyMuPDF") from e

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import fitz

        for b in rows:
            out: dict[str, list] = {"source": [], "page": [], "text": []}
            for source, content in zip(b.column("source").to_pylist(), b.column("content").to_pylist()):
                try:
                    pages = [p.get_text() for p in fitz.open(stream=content, filetype="pdf")]
                except (RuntimeError, ValueError) as e:
                    logger.warning("%s can't be read: %s", source, e)
                    continue
                for i, t in enumerate(pages, 1):
                    if t.strip():
                        for k, v in (("source", source), ("page", i), ("text", t)):
                            out[k].append(v)
            yield pa.record_batch({"source": pa.array(out["source"], pa.string()), "page": pa.array(out["page"], pa.int32()), "text": pa.array(out["text"], pa.string())})

    return files.select("source", "content").mapInArrow(run, "source string, page int, text string")


LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {".txt": _text, ".md": _text, ".html": _html, ".htm": _html, ".pdf": _pdf}


def register_loader(suffix: str, loader: Callable[[DataFrame], DataFrame]) -> None:
    """loader gets files (source, content) and returns source, page, text."""
    LOADERS[suffix.lower()] = loader


def load_documents(spark: SparkSession, path: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """text, source, page, chunk_index, total_chunks of a file, or of all files below a folder, in the order of source.

    A path that isn't there gives no rows and a warning; unknown kinds are left out. A loader that can't run here
    is left out with a warning if other files could be read.
    """
    empty = spark.createDataFrame([], "text string, source string, page int, chunk_index int, total_chunks int")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        logger.warning("%s doesn't exist", path)
        return empty
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source"), "content")
    suffix = F.lower(F.regexp_extract("source", r"(\.[^./]+)$", 1))
    found = {r[0] for r in files.select(suffix).distinct().collect()}  # kinds of files, a handful
    parts = []
    for loader in dict.fromkeys(LOADERS[s] for s in sorted(found & set(LOADERS))):
        mine = [s for s in found if LOADERS.get(s) is loader]
        try:
            parts.append(loader(files.filter(suffix.isin(mine))))
        except ImportError as e:
            logger.warning("%s left out: %s", ", ".join(mine), e)
    if not parts:
        return empty
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    return chunk_text(docs, size, overlap).select(F.col("chunk").alias("text"), "source", "page", "chunk_index", "total_chunks").orderBy("source", "page", "chunk_index")
