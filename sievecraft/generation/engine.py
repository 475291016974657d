"""The run: prompts per batch, model calls in Python workers, replies written once, then parsed and curated.

Batches go in waves, so that a budget can stop the run between them. A wave's replies are one partition of a table in
the checkpoint folder; resuming is an anti-join of all batches with those that are there.
"""

from __future__ import annotations

import hashlib
import json
import logging
import math
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import LANGUAGES
from ..operators.dedup import deduplicate
from ..operators.filters import validate_samples
from ..operators.pipeline import build_steps, run_steps
from ..operators.retrieval import retrieve
from ..sinks import StreamingWriter, export
from ..sources.documents import load_documents
from ..sources.samples import METADATA, read_samples
from ..storage import delete, exists, materialize, shared_folder
from .providers import create_provider
from .strategies import AutoOptimize, create_strategy
from .tasks import Task, create_task

logger = logging.getLogger(__name__)
OVERSHOOT = 1.2
#: Dollars per million tokens, input and output.
PRICES = {
    "gpt-3.5-turbo": (0.5, 1.5),
    "gpt-4-turbo": (10.0, 30.0),
    "gpt-4o": (2.5, 10.0),
    "gpt-4o-mini": (0.15, 0.6),
    "claude-3-5-haiku": (0.8, 4.0),
    "claude-3-5-sonnet": (3.0, 15.0),
    "claude-haiku-4-5": (0.8, 4.0),
    "claude-opus-4-6": (15.0, 75.0),
    "claude-sonnet-4-6": (3.0, 15.0),
}
REPLIES = "batch_index int, content string, input_tokens long, output_tokens long, attempts int"


def estimate_cost(input_tokens: int, output_tokens: int, model: str) -> float:
    """Of the model by that name, else of the longest known name in it or that it is in; 0 if there is none."""
    price = PRICES.get(model)
    if not price and model:
        near = sorted((k for k in PRICES if k in model or model in k), key=len, reverse=True)
        price = PRICES[near[0]] if near else None
    return (input_tokens * price[0] + output_tokens * price[1]) / 1e6 if price else 0.0


def plan_batches(num_samples: int, batch_size: int) -> int:
    return math.ceil(math.ceil(num_samples * OVERSHOOT) / batch_size)


def estimate_run(config: dict) -> dict[str, Any]:
    """Batches, tokens (a quarter of the characters in, three times that out) and cost of a run."""
    gen = config.get("generation", {})
    size = gen.get("batch_size", 10)
    batches = plan_batches(gen.get("num_samples", 100), size)
    model = config.get("provider", {}).get("model", "unknown")
    per_batch = sum(len(m["content"]) for m in create_task(config).build_messages(size)) // 4
    tokens_in, tokens_out = per_batch * batches, per_batch * 3 * batches
    return {
        "model": model,
        "num_batches": batches,
        "batch_size": size,
        "estimated_input_tokens": tokens_in,
        "estimated_output_tokens": tokens_out,
        "estimated_total_tokens": tokens_in + tokens_out,
        "estimated_cost_usd": estimate_cost(tokens_in, tokens_out, model),
    }


def config_hash(config: dict) -> str:
    """Of everything but output."""
    return hashlib.sha256(json.dumps({k: v for k, v in config.items() if k != "output"}, sort_keys=True, default=str).encode()).hexdigest()[:16]


def _append_to_user(messages: list[dict], text: str) -> list[dict]:
    at = next((i for i, m in enumerate(messages) if m["role"] == "user"), None)
    return [{**m, "content": f"{m['content']}\n\n{text}"} if i == at else m for i, m in enumerate(messages)]


def in_language(messages: list[dict], language: str | None) -> list[dict]:
    if not language:
        return messages
    return _append_to_user(messages, f"Write every text in {LANGUAGES.get(language, language)}, whatever the language of this request.")


def grounding_window(batch_index: int, n: int, width: int = 3) -> list[int]:
    """Places of the chunks that a batch is grounded on: width of n, going round."""
    w = min(width, n)
    return [(batch_index * w + k) % n for k in range(w)]


def grounded(messages: list[dict], chunks: list[str]) -> list[dict]:
    return _append_to_user(messages, "Rest on these passages:\n\n" + "\n\n---\n\n".join(chunks)) if chunks else messages


def render_prompts(spark: SparkSession, config: dict, task: Task, strategy: Any, batches: list[int]) -> DataFrame:
    """batch_index, messages: rendered on the driver (one short prompt per batch), grounded by a join if there are many chunks."""
    gen = config.get("generation", {})
    base = task.build_messages(gen.get("batch_size", 10))
    prompts = {i: in_language(strategy.apply(base, i), config.get("language")) for i in batches}
    if config.get("from_docs"):
        chunks = materialize(load_documents(spark, config["from_docs"]).withColumn("place", F.monotonically_increasing_id()), "chunks")
        n = chunks.count()
        if 0 < n <= 10:
            texts = [r["text"] for r in chunks.orderBy("source", "page", "chunk_index").collect()]  # ten at most
            prompts = {i: grounded(m, [texts[k] for k in grounding_window(i, n)]) for i, m in prompts.items()}
        elif n:
            asked = spark.createDataFrame([(i, next((m["content"] for m in p if m["role"] == "user"), "")) for i, p in prompts.items()], "query_id int, text string")
            best = retrieve(chunks.select(F.col("place").alias("doc_id"), "text"), asked).join(chunks.select(F.col("place").alias("doc_id"), "text"), "doc_id")
            found: dict[int, list] = {}
            for r in best.select("query_id", "rank", "text").collect():  # three a batch
                found.setdefault(r["query_id"], []).append((r["rank"], r["text"]))
            prompts = {i: grounded(m, [t for _, t in sorted(found.get(i, []))]) for i, m in prompts.items()}
    rows = [(i, json.dumps(m, ensure_ascii=False)) for i, m in prompts.items()]
    return spark.createDataFrame(rows, "batch_index int, messages string")


def call_model(prompts: DataFrame, provider: dict, temperature: float, workers: int) -> DataFrame:
    """REPLIES: one call a batch; a call that fails has null content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = create_provider(provider)
        for f in frames:
            out = []
            for index, messages in zip(f["batch_index"], f["messages"]):
                try:
                    r = client.complete(json.loads(messages), temperature=temperature)
                    out.append((index, r.content, r.input_tokens or 0, r.output_tokens or 0, 1))
                except (OSError, ValueError, RuntimeError, KeyError) as e:
                    logger.warning("batch %s: %s", index, e)
                    out.append((index, None, 0, 0, 1))
            yield pd.DataFrame(out, columns=["batch_index", "content", "input_tokens", "output_tokens", "attempts"])

    return prompts.repartition(workers).mapInPandas(run, REPLIES)


def replies_of(prompts: DataFrame, task: Task, provider: dict, temperature: float, max_retries: int, workers: int) -> DataFrame:
    """REPLIES, one a batch: up to max_retries + 1 calls until the reply gives a valid sample; tokens add up over the calls.

    Each turn calls for the batches that have none so far, as one job. A batch that never gives one has null content.
    """
    todo, made = prompts, None
    for turn in range(max_retries + 1):
        new = materialize(call_model(todo, provider, temperature, workers), "replies")
        good = task.valid(task.parse(new.select("batch_index", "content"), "content")).select("batch_index").distinct().withColumn("good", F.lit(True))
        new = materialize(new.join(good, "batch_index", "left").withColumn("turn", F.lit(turn)), "judged-replies")
        made = new if made is None else made.union(new)
        todo = prompts.join(new.filter("good"), "batch_index", "left_anti") if turn == 0 else todo.join(new.filter("good"), "batch_index", "left_anti")
        if new.filter("good IS NULL").isEmpty():
            break
    content = F.max_by(F.when(F.col("good"), F.col("content")), F.when(F.col("good"), F.col("turn")))
    return made.groupBy("batch_index").agg(content.alias("content"), *[F.sum(c).cast("long").alias(c) for c in ("input_tokens", "output_tokens")], F.count("*").cast("int").alias("attempts"))


class Checkpoint:
    """Replies by configuration, as Parquet: a wave is appended whole, so what is there is complete."""

    def __init__(self, spark: SparkSession, config: dict, folder: str | None = None):
        self.spark = spark
        self.folder = folder or config.get("checkpoint_dir") or f"{shared_folder(spark)}/generation"
        self.path = f"{self.folder}/{config_hash(config)}"

    def save(self, replies: DataFrame) -> None:
        replies.write.mode("append").parquet(self.path)

    def load(self) -> DataFrame | None:
        if not exists(self.spark, f"{self.path}/_SUCCESS"):
            return None
        return self.spark.read.schema(REPLIES).parquet(self.path)

    def cleanup(self) -> None:
        delete(self.spark, self.path)


def parse_replies(replies: DataFrame, task: Task) -> DataFrame:
    """Samples with seq in the order of batch and place."""
    rows = task.valid(task.parse(replies.select("batch_index", "content"), "content"))
    seq = F.shiftleft(F.col("batch_index").cast("long"), 20) + F.col("pos")
    missing = {k: F.lit(None).cast(v) for k, v in METADATA.items() if k not in rows.columns and k in task.metadata}
    return rows.withColumns({"seq": seq, **missing}).drop("batch_index", "pos")


def generate(spark: SparkSession, config: dict, resume: bool = False) -> DataFrame:
    """Run a configuration and write its output; returns the curated samples, num_samples of them at most."""
    gen, quality, output = (config.get(k, {}) for k in ("generation", "quality", "output"))
    wanted, workers = gen.get("num_samples", 100), gen.get("max_workers", 10)
    task, provider = create_task(config), config.get("provider", {})
    name, own = gen.get("strategy", "direct"), dict(gen.get("strategy_config") or {})
    if config.get("seed_from"):
        rows = read_samples(spark, config["seed_from"]).orderBy("seq").limit(3).collect()  # as many as a prompt shows
        own["examples"] = [{k: v for k, v in r.asDict(True).items() if v is not None and k != "seq"} for r in rows]
        name = "few_shot" if name == "direct" else name
    strategy = create_strategy(name, own)
    if own.get("auto_optimize"):

        def parse(text: str) -> list[dict]:
            frame = spark.createDataFrame([(text,)], "response string")
            return [r.asDict(True) for r in task.parse(frame).drop("pos").limit(20).collect()]

        strategy = AutoOptimize(strategy, create_provider(provider), parse, own.get("calibration_size", 5))

    checkpoint = Checkpoint(spark, config)
    if not resume:
        checkpoint.cleanup()
    have = checkpoint.load()
    done = {r[0] for r in have.select("batch_index").collect()} if have is not None else set()
    todo = [i for i in range(plan_batches(wanted, gen.get("batch_size", 10))) if i not in done]
    writer = StreamingWriter(output.get("path", "data/output.jsonl")) if config.get("stream") else None
    cap = gen.get("max_cost")
    wave = max(1, workers) * (4 if cap or writer else max(1, len(todo)))
    if todo:
        prompts = materialize(render_prompts(spark, config, task, strategy, todo), "prompts")
    for begin in range(0, len(todo), wave):
        part = prompts.filter(F.col("batch_index").isin(todo[begin : begin + wave])) if wave < len(todo) else prompts
        replies = materialize(replies_of(part, task, provider, gen.get("temperature", 0.7), gen.get("max_retries", 3), workers), "replies")
        checkpoint.save(replies)
        if writer:
            writer.write_batch(parse_replies(replies, task))
        if cap:
            used = checkpoint.load().agg(F.sum("input_tokens"), F.sum("output_tokens")).first()
            if estimate_cost(used[0] or 0, used[1] or 0, provider.get("model", "")) >= cap:
                logger.warning("the budget of %s is used up", cap)
                break
    raw = checkpoint.load()
    samples = parse_replies(raw if raw is not None else spark.createDataFrame([], REPLIES), task)
    samples = curate(materialize(samples, "samples"), config, task)
    if writer:
        writer.close()
    export(samples, output.get("path", "data/output.jsonl"), output.get("format", "jsonl"))
    checkpoint.cleanup()
    return samples


def curate(samples: DataFrame, config: dict, task: Task | None = None) -> DataFrame:
    """Dedup, validation, quality steps, judge, trim: in this order, which is part of the meaning."""
    quality = config.get("quality", {})
    samples = deduplicate(samples, quality.get("similarity_threshold", 0.85))
    labels = getattr(task, "labels", None)
    samples = validate_samples(samples, quality.get("min_length", 10), quality.get("max_length", 10_000), labels)
    steps = list(quality.get("steps") or [])
    language = config.get("language")
    if language and not any("language" in s for s in steps):
        if language not in ("en", "es", "fr", "de", "pt", "it", "ru"):
            logger.warning("texts in %s can't be told from others: the language filter removes all of them", language)
        steps.insert(0, {"language": {"expected": language}})
    judge = config.get("validation")
    if judge:
        shared = {**config.get("provider", {}), "model": judge.get("model", "")}
        steps.append({"llm_judge": {"provider_config": shared, "threshold": judge.get("threshold", 3.0), "action": judge.get("action", "remove")}})
    samples, _ = run_steps(materialize(samples, "curated"), build_steps(steps))
    return materialize(samples.orderBy("seq").limit(config.get("generation", {}).get("num_samples", 100)), "final")


async def async_generate(spark: SparkSession, config: dict, resume: bool = False) -> DataFrame:
    """generate() without blocking the event loop; the calls themselves run in Spark's workers either way."""
    import asyncio

    return await asyncio.to_thread(generate, spark, config, resume)
