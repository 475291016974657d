"""Dataset cards: front matter, a table of the run, label counts and three examples."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators.metrics import label_distribution
from .sinks import export, records
from .storage import Output

CATEGORIES = {
    "classification": "text-classification",
    "ner": "token-classification",
    "preference": "text-generation",
    "qa": "question-answering",
    "summarization": "summarization",
}
SIZES = ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"))


def size_category(n: int) -> str:
    return next((name for end, name in SIZES if n < end), "n>1M")


def size_category_column(n: Column) -> Column:
    out = F.lit("n>1M")
    for end, name in reversed(SIZES):
        out = F.when(n < end, name).otherwise(out)
    return out


def generate_card(samples: DataFrame, name: str, config: dict | None = None) -> str:
    config = config or {}
    gen = config.get("generation", {})
    kind = config.get("type") or config.get("task", {}).get("type") or "unknown"
    n = samples.count()
    labels = label_distribution(samples).orderBy(F.desc("n"), "first_seq").collect()  # one row per label
    head = ["---", "task_categories:", f"  - {CATEGORIES.get(kind, 'text-generation')}", "size_categories:", f"  - {size_category(n)}", "tags:", "  - synthetic", *([f"  - {kind}"] if labels else []), "---", ""]
    rows = {"Model": config.get("provider", {}).get("model", "unknown"), "Strategy": gen.get("strategy", "direct"), "Task": kind, "Rows": f"{n:,}"} | ({"Temperature": gen["temperature"]} if gen.get("temperature") is not None else {})
    out = [*head, f"# {name.split('/')[-1]}", "", f"{n:,} synthetic samples of the kind {kind}.", "", "| | |", "|-|-|", *[f"| {k} | {v} |" for k, v in rows.items()]]
    if labels:
        out += ["", "## Labels", "", "| label | rows | share |", "|-|-|-|", *[f"| {r['label']} | {r['n']:,} | {100 * r['share']:.1f}% |" for r in labels]]
    out += ["", "## Examples"]
    for r in records(samples.orderBy("seq").limit(3)).orderBy("seq").collect():
        out += ["", "```json", json.dumps(json.loads(r["value"]), indent=2, ensure_ascii=False), "```"]
    return "\n".join(out) + "\n"


def publish(samples: DataFrame, folder: str, name: str, config: dict | None = None) -> str:
    """Data and card in a local folder that any dataset hub can be fed from; returns the folder."""
    export(samples, folder, "huggingface")
    with Output(samples.sparkSession, f"{folder}/README.md") as f:
        f.write(generate_card(samples, name, config))
    return folder
