"""Command line: init, generate, validate, export, evaluate, push, info."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import card, sinks
from .config import load_config, merge
from .generation.engine import PRICES, estimate_run, generate
from .generation.strategies import STRATEGIES
from .generation.tasks import TASKS
from .operators.dedup import deduplicate
from .operators.filters import validate_samples
from .operators.metrics import entity_distribution, evaluate_dataset, label_distribution
from .operators.pipeline import STEPS
from .sources.samples import read_samples

#: Where options of generate go in the configuration.
_OPTIONS = {
    "labels": ("task", "labels"),
    "entity_types": ("task", "entity_types"),
    "domain": ("task", "domain"),
    "model": ("provider", "model"),
    "base_url": ("provider", "base_url"),
    "api_key": ("provider", "api_key"),
    "provider": ("provider", "kind"),
    "timeout": ("provider", "timeout"),
    "strategy": ("generation", "strategy"),
    "num_samples": ("generation", "num_samples"),
    "max_workers": ("generation", "max_workers"),
    "max_cost": ("generation", "max_cost"),
    "output": ("output", "path"),
    "format": ("output", "format"),
    "from_docs": ("from_docs",),
    "seed_from": ("seed_from",),
    "language": ("language",),
    "validate_model": ("validation", "model"),
    "stream": ("stream",),
}
_NUMBERS = {"num_samples": int, "max_workers": int, "max_cost": float, "timeout": float}


def session() -> SparkSession:
    return SparkSession.builder.appName("sievecraft").getOrCreate()


def template(task: str) -> dict:
    """A configuration to start from."""
    own = {f.name: f.default for f in fields(TASKS[task]) if isinstance(f.default, (str, int))}
    if task == "classification":
        own["labels"] = ["positive", "negative"]
    if task == "ner":
        own["entity_types"] = ["PERSON", "ORG", "LOC"]
    return merge(load_config("/nonexistent"), {"type": task, "task": own})


def options_to_config(options: dict) -> dict:
    out: dict = {"type": options["task"]} if options.get("task") else {}
    for key, path in _OPTIONS.items():
        if options.get(key):
            at = out
            for k in path[:-1]:
                at = at.setdefault(k, {})
            at[path[-1]] = options[key]
    return out


def _init(o: argparse.Namespace) -> int:
    import yaml

    if o.task not in TASKS:
        print(f"no task is named {o.task}; there are {', '.join(TASKS)}", file=sys.stderr)
        return 1
    out = Path(o.output)
    if out.exists() and not o.force and input(f"{out} exists. Overwrite it? [y/N] ").strip().lower() != "y":
        return 1
    made = template(o.task)
    for key in ("labels", "entity_types"):
        if getattr(o, key):
            made["task"][key] = [x.strip() for x in getattr(o, key).split(",")]
    out.write_text(yaml.safe_dump(made, sort_keys=False), encoding="utf-8")
    return 0


def _generate(o: argparse.Namespace) -> int:
    config = merge(load_config(o.config), options_to_config(vars(o)))
    if o.dry_run:
        print(json.dumps(estimate_run(config), indent=2))
        return 0
    n = generate(session(), config, resume=o.resume).count()
    print(f"{n} samples in {config['output']['path']}")
    return 0


def curated(samples: DataFrame, threshold: float = 0.85) -> DataFrame:
    """What validate keeps: dedup, then lengths."""
    return validate_samples(deduplicate(samples, threshold))


def _validate(o: argparse.Namespace) -> int:
    spark, source = session(), Path(o.input)
    samples = read_samples(spark, str(source))
    kept = curated(samples, o.threshold)
    before, after = samples.count(), kept.count()
    print(f"{before} rows, {after} stay")
    for r in label_distribution(kept.filter("label <> ''")).orderBy(F.desc("n"), "first_seq").collect():
        print(f"  {r['label']}: {r['n']} ({100 * r['n'] / after:.1f}%)")
    for r in entity_distribution(kept).orderBy(F.desc("n"), "label").collect():
        print(f"  entity {r['label']}: {r['n']}")
    sinks.write_jsonl(kept, o.output or str(source.with_name(f"{source.stem}_clean.jsonl")))
    return 0


def _export(o: argparse.Namespace) -> int:
    source = Path(o.input)
    suffix = {"csv": "csv", "parquet": "", "huggingface": "", "alpaca": "json"}.get(o.format, "jsonl")
    path = o.output or str(source.with_name(f"{source.stem}_{o.format}" + (f".{suffix}" if suffix else "")))
    sinks.export(read_samples(session(), str(source)), path, o.format)
    print(path)
    return 0


def _evaluate(o: argparse.Namespace) -> int:
    found = evaluate_dataset(read_samples(session(), o.input))
    if o.json:
        print(json.dumps(found, indent=2, ensure_ascii=False))
    else:
        for k, v in found.items():
            print(f"{k}: {v}")
    return int("error" in found)


def _push(o: argparse.Namespace) -> int:
    print(card.publish(read_samples(session(), o.input), o.folder, o.name, load_config(o.config) if o.config else None))
    return 0


def _info(_: argparse.Namespace) -> int:
    for what, names in (("tasks", TASKS), ("strategies", STRATEGIES), ("formats", sinks.WRITERS), ("quality steps", STEPS), ("models with known prices", PRICES)):
        print(f"{what}: {', '.join(names)}")
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sievecraft", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(name: str, run, *positional: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for x in positional:
            c.add_argument(x)
        return c

    c = command("init", _init, "task")
    for x in ("labels", "entity-types"):
        c.add_argument(f"--{x}")
    c.add_argument("--output", default="config.yaml")
    c.add_argument("--force", action="store_true")
    c = command("generate", _generate)
    c.add_argument("--config", "-c")
    c.add_argument("--task", "-t", choices=TASKS)
    for key in _OPTIONS:
        if key == "stream":
            c.add_argument("--stream", action="store_true")
        else:
            c.add_argument(f"--{key.replace('_', '-')}", type=_NUMBERS.get(key, str))
    for flag in ("resume", "dry-run"):
        c.add_argument(f"--{flag}", action="store_true")
    c = command("validate", _validate, "input")
    c.add_argument("--output", "-o")
    c.add_argument("--threshold", type=float, default=0.85)
    c = command("export", _export, "input")
    c.add_argument("--format", "-f", default="jsonl", choices=sinks.WRITERS)
    c.add_argument("--output", "-o")
    c = command("evaluate", _evaluate, "input")
    c.add_argument("--json", action="store_true")
    c = command("push", _push, "input", "folder", "name")
    c.add_argument("--config", "-c")
    command("info", _info)
    return p


def main(argv: list[str] | None = None) -> int:
    o = parser().parse_args(argv)
    return o.run(o)
