"""Readers of sample files, and the sample schema: seq, text, label, typed metadata columns, extra."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

MESSAGES = "array<struct<role: string, content: string>>"
ENTITIES = "array<struct<text: string, label: string, start: int, end: int>>"
#: Metadata that tasks and quality steps write.
METADATA = {
    "entities": ENTITIES,
    "context": "string",
    "chosen": "string",
    "rejected": "string",
    "instruction": "string",
    "response": "string",
    "system_prompt": "string",
    "messages": MESSAGES,
    "teacher_response": "string",
    "reasoning": "string",
    "input": "string",
    "answer": "string",
    "pii_detected": "array<string>",
    "pii_redacted": "boolean",
    "toxic_keywords": "array<string>",
    "detected_language": "string",
    "language_confidence": "double",
    "judge_score": "double",
}


def with_seq(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with seq, a dense row number in the given order.

    Rows are range-sorted and numbered inside their partition; the partitions' offsets (one number each) are added.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    marked = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    if order:  # range borders are sampled anew by each plan: both uses read the same partitions
        marked = materialize(marked, "numbered")
    counts = marked.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # one row per partition
    place = F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)
    return marked.join(F.broadcast(offsets), "_part").withColumn("seq", F.col("_before") + place).drop("_part", "_id", "_before")


def _in_files(df: DataFrame) -> DataFrame:
    """Rows just read from files with _at, where each one came from: file, block of it, place in the order of reading.

    Spark deals files to partitions by size, so that the order of partitions isn't that of the files.
    """
    origin = df.metadataColumn("_metadata")
    return df.withColumn("_at", F.struct(origin["file_path"].alias("file"), origin["file_block_start"].alias("block")))


def _by_file(df: DataFrame) -> DataFrame:
    """df (_in_files, with _id by partition) with seq, a dense row number by file, block and line, without sorting any row.

    A block is read by one task, so that its rows have consecutive numbers; the blocks' offsets (one row each) are added.
    """
    blocks = df.groupBy("_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = blocks.select("_at", (before - F.col("_first")).alias("_shift"))
    return df.join(F.broadcast(offsets), "_at").withColumn("seq", F.col("_id") + F.col("_shift")).drop("_at", "_id", "_shift")


def samples_of(df: DataFrame, seq: str, text: str, label: str | None = None) -> DataFrame:
    """Any table as samples: seq, text, label."""
    return df.select(F.col(seq).cast("long").alias("seq"), F.col(text).alias("text"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; blank lines are skipped, bad JSON raises when read.

    seq follows files and lines. Keys beyond text, label and metadata go over an explicit metadata object; known
    ones become typed columns and the rest lands in extra, values as JSON.
    """
    lines = _in_files(spark.read.text(path)).filter(F.trim("value") != "").withColumn("_id", F.monotonically_increasing_id())
    json = F.parse_json(F.btrim("value"))
    typed = _by_file(lines).select("seq", "value", json.alias("v"))
    top = F.from_json("value", "map<string,string>")
    nested = F.coalesce(F.from_json(F.get_json_object("value", "$.metadata"), "map<string,string>"), F.create_map().cast("map<string,string>"))
    own = F.map_filter(top, lambda k, _: ~k.isin("text", "label", "metadata"))
    return _typed(typed.select("seq", F.coalesce(F.variant_get("v", "$.text", "string"), F.lit("")).alias("text"), F.variant_get("v", "$.label", "string").alias("label"), nested.alias("n"), own.alias("o")))


def _typed(t: DataFrame) -> DataFrame:
    """The columns of METADATA out of two maps of JSON values (o over n); extra has the others."""
    merged = F.map_concat(F.map_filter("n", lambda k, _: ~F.map_contains_key("o", k)), F.col("o"))
    t = t.withColumn("m", merged)
    columns = {}
    for name, kind in METADATA.items():
        raw = F.element_at("m", F.lit(name))
        columns[name] = raw if kind == "string" else raw.cast(kind) if kind in ("boolean", "double") else F.from_json(raw, kind)
    extra = F.map_filter("m", lambda k, _: ~k.isin(*METADATA))
    t = t.withColumns(columns).withColumn("extra", F.when(F.size(extra) > 0, extra)).drop("n", "o", "m")
    return materialize(t.select(*[c for c in t.columns if c != "seq"], "seq"), "numbered")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and strings. An empty text or label stays ""; empty cells of other columns count as absent."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', charToEscapeQuoteEscaping='"', inferSchema=False)
    t = _by_file(_in_files(raw).withColumn("_id", F.monotonically_increasing_id()))
    others = [c for c in raw.columns if c not in ("text", "label")]
    cells = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in others]), lambda e: e["value"].isNotNull() & (e["value"] != ""))) if others else F.create_map().cast("map<string,string>")
    text = F.coalesce("text", F.lit("")) if "text" in raw.columns else F.lit("")
    label = F.coalesce("label", F.lit("")) if "label" in raw.columns else F.lit(None).cast("string")
    return _typed(t.select("seq", text.alias("text"), label.alias("label"), F.create_map().cast("map<string,string>").alias("n"), cells.alias("o")))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """read_csv for .csv in any case, else read_jsonl."""
    return (read_csv if PurePosixPath(path).suffix.lower() == ".csv" else read_jsonl)(spark, path)
