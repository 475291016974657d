"""Seven output formats. Each layout is a select of native expressions, then a distributed write."""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sources.samples import MESSAGES
from .storage import Output, materialize

ROLES = {"user": "human", "assistant": "gpt"}


def _has(samples: DataFrame, name: str, kind: str = "string") -> Column:
    """A column of samples, or null where there is none."""
    return F.col(name) if name in samples.columns else F.lit(None).cast(kind)


def _first(samples: DataFrame, *names: str) -> Column:
    return F.coalesce(*[_has(samples, n).cast("string") for n in names], F.lit(""))


def records(samples: DataFrame) -> DataFrame:
    """seq, value: each row flat as JSON, without nulls; the keys of extra come last."""
    core = [c for c in samples.columns if c not in ("seq", "extra")]
    order = ["text", "label", *[c for c in core if c not in ("text", "label")]]
    flat = F.to_json(F.struct(*[F.col(c) for c in order if c in core]))
    if "extra" in samples.columns:
        # values of extra that are JSON already go in as they are; plain strings are quoted
        quote = lambda s: F.regexp_extract(F.to_json(F.array(s)), r"(?s)^\[(.*)\]$", 1)
        is_json = lambda v: F.try_parse_json(v).isNotNull() & ~F.rlike(v, F.lit(r'^\s*"'))
        items = F.transform(F.map_entries("extra"), lambda e: F.concat(quote(e["key"]), F.lit(":"), F.when(is_json(e["value"]), e["value"]).otherwise(quote(e["value"]))))
        more = F.array_join(items, ",")
        flat = F.when(F.size("extra") > 0, F.concat(F.substring(flat, F.lit(1), F.length(flat) - 1), F.when(F.length(flat) > 2, ",").otherwise(""), more, F.lit("}"))).otherwise(flat)
    return samples.select("seq", flat.alias("value"))


def messages(samples: DataFrame) -> Column:
    """Messages as they are, else system (if any), user (instruction or text, input below it) and assistant (if any)."""
    system = _has(samples, "system_prompt")
    given = _has(samples, "input")
    user = F.concat(_first(samples, "instruction", "text"), F.when(F.coalesce(given, F.lit("")) != "", F.concat(F.lit("\n\n"), given)).otherwise(""))
    answer = _first(samples, "response", "label", "answer")

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    none = F.lit(None).cast("struct<role: string, content: string>")
    made = F.array(F.when(F.coalesce(system, F.lit("")) != "", turn("system", system)).otherwise(none), turn("user", user), F.when(answer != "", turn("assistant", answer)).otherwise(none))
    return F.coalesce(_has(samples, "messages", MESSAGES), F.array_compact(made))


def openai(samples: DataFrame) -> DataFrame:
    return samples.select("seq", F.struct(messages(samples).alias("messages")).alias("record"))


def alpaca(samples: DataFrame) -> DataFrame:
    return samples.select("seq", F.struct(_first(samples, "instruction", "text").alias("instruction"), _first(samples, "input").alias("input"), _first(samples, "response", "label", "answer").alias("output")).alias("record"))


def sharegpt(samples: DataFrame) -> DataFrame:
    """conversations of (from, value): all messages if there are any, else human and, if not empty, gpt."""
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    turns = F.transform(_has(samples, "messages", MESSAGES), lambda m: F.struct(F.coalesce(F.try_element_at(role, m["role"]), m["role"]).alias("from"), m["content"].alias("value")))
    answer = _first(samples, "response", "label", "answer")

    def turn(who: str, what: Column) -> Column:
        return F.struct(F.lit(who).alias("from"), what.alias("value"))

    single = F.array(turn("human", _first(samples, "instruction", "text")))
    both = F.concat(single, F.array(turn("gpt", answer)))
    return samples.select("seq", F.struct(F.coalesce(turns, F.when(answer != "", both).otherwise(single)).alias("conversations")).alias("record"))


def write_lines(values: DataFrame, path: str) -> None:
    """values (seq, value) in the order of seq: into one file if path has a suffix, else as part files in a folder.

    A single file is streamed through the driver partition by partition; a folder is written by the tasks.
    """
    if Path(path).suffix:
        with Output(values.sparkSession, path) as f:
            f.writelines(r["value"] + "\n" for r in values.orderBy("seq").select("value").toLocalIterator())
    else:
        values.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.mode("overwrite").text(path)


def _json(layout: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda s: layout(s).select("seq", F.to_json("record").alias("value"))


def write_jsonl(samples: DataFrame, path: str) -> None:
    write_lines(records(samples), path)


def write_openai_finetune(samples: DataFrame, path: str) -> None:
    write_lines(_json(openai)(samples), path)


def write_sharegpt(samples: DataFrame, path: str) -> None:
    write_lines(_json(sharegpt)(samples), path)


def write_alpaca(samples: DataFrame, path: str) -> None:
    """One JSON array. Rows are streamed through the driver, never held there at once."""
    with Output(samples.sparkSession, path) as f:
        f.write("[")
        for i, r in enumerate(_json(alpaca)(samples).orderBy("seq").toLocalIterator()):
            body = json.dumps(json.loads(r["value"]), ensure_ascii=False, indent=2)
            f.write(("," if i else "") + "\n" + "\n".join("  " + x for x in body.split("\n")))
        f.write("\n]\n")


def csv_columns(samples: DataFrame) -> DataFrame:
    """seq and string columns: complex values as JSON, null as "". Columns without any value are left out."""
    names = [c for c in samples.columns if c != "seq"]
    some = samples.agg(*[F.count(F.col(c)).alias(c) for c in names]).first()
    used = [c for c in names if c == "text" or some[c]]
    kinds = dict(samples.dtypes)
    cell = {c: F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c).cast("string") for c in used}
    return samples.select("seq", *[F.coalesce(v, F.lit("")).alias(c) for c, v in cell.items()])


def write_csv(samples: DataFrame, path: str) -> None:
    """A header of all columns with a value; no rows, no file."""
    if samples.isEmpty():
        return
    out = csv_columns(samples)
    if not Path(path).suffix:
        # else Spark trims the cells, and cells without quotes at their ends lose more
        exact = {"quoteAll": True, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        out.repartitionByRange("seq").sortWithinPartitions("seq").drop("seq").write.mode("overwrite").csv(path, header=True, escape='"', charToEscapeQuoteEscaping='"', **exact)
        return
    import csv

    with Output(samples.sparkSession, path) as f:
        w = csv.writer(f)
        w.writerow(c for c in out.columns if c != "seq")
        w.writerows(r[1:] for r in out.orderBy("seq").toLocalIterator())


def write_parquet(samples: DataFrame, path: str) -> None:
    samples.drop("seq").write.mode("overwrite").parquet(path)


def write_huggingface(samples: DataFrame, path: str) -> None:
    """Parquet shards and a dataset_info.json with columns and row count."""
    samples.drop("seq").write.mode("overwrite").parquet(f"{path}/data")
    n = samples.sparkSession.read.parquet(f"{path}/data").count()
    info = {"features": {c: {"dtype": k} for c, k in samples.drop("seq").dtypes}, "splits": {"train": {"num_examples": n}}}
    with Output(samples.sparkSession, f"{path}/dataset_info.json") as f:
        f.write(json.dumps(info, indent=2) + "\n")


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {
    "jsonl": write_jsonl,
    "csv": write_csv,
    "parquet": write_parquet,
    "huggingface": write_huggingface,
    "openai": write_openai_finetune,
    "alpaca": write_alpaca,
    "sharegpt": write_sharegpt,
}


def export(samples: DataFrame, path: str, fmt: str = "jsonl") -> None:
    if fmt not in WRITERS:
        raise ValueError(f"format is {fmt!r}; it must be one of {', '.join(WRITERS)}")
    WRITERS[fmt](samples, path)


class StreamingWriter:
    """JSONL that is emptied when opened and grows by each batch; count says how many rows were written.

    A path without a scheme or with file:// is one file; on other file systems, which can't append, it is a folder
    of part files.
    """

    def __init__(self, path: str):
        self.path, self.count, self.opened = path, 0, False
        self.file = Path(path.removeprefix("file://")) if "://" not in path.removeprefix("file://") else None
        if self.file:
            if self.file.is_dir():
                shutil.rmtree(self.file)
            self.file.parent.mkdir(parents=True, exist_ok=True)
            self.file.write_text("")

    def write_batch(self, samples: DataFrame) -> None:
        lines = records(samples)
        if not self.file:
            lines = materialize(lines, "streamed")
            lines.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.mode("append" if self.opened else "overwrite").text(self.path)
            self.count, self.opened = self.count + lines.count(), True
            return
        with self.file.open("a", encoding="utf-8") as f:
            for r in lines.orderBy("seq").toLocalIterator():
                f.write(r["value"] + "\n")
                self.count += 1

    def close(self) -> None:
        """Nothing is left open between batches."""

    def __enter__(self) -> StreamingWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
