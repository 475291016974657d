"""A model scores rows in groups of consecutive ones; rows under the threshold go or are flagged."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_response
from ..generation.providers import create_provider
from ..sources.samples import with_seq
from ..storage import materialize
from .report import StepReport

logger = logging.getLogger(__name__)
PROMPT = 'Score each text for quality from 1 (useless) to 5 (excellent).\n\n{samples}\n\nAnswer with JSON only: [{{"index": 0, "score": 4.5}}]'


def parse_scores(reply: Column, expected: Column, threshold: float) -> Column:
    """Array of expected scores: by index from a JSON array, threshold where one lacks; if that can't be read, the first
    numbers from 1 to 5 in the reply if there are enough; else the threshold."""
    clean = clean_response(reply)
    items = F.try_variant_get(F.try_parse_json(clean), "$", "array<variant>")
    pairs = F.transform(items, lambda v: F.struct(F.try_variant_get(v, "$.index", "int").alias("i"), F.try_variant_get(v, "$.score", "double").alias("s")))
    sound = items.isNotNull() & F.forall(pairs, lambda p: p["i"].isNotNull() & p["s"].isNotNull())
    places = F.when(expected > 0, F.sequence(F.lit(0), expected - 1)).otherwise(F.array().cast("array<int>"))
    # of items with the same index the last counts
    by_index = F.transform(places, lambda i: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["i"] == i), F.lit(-1))["s"], F.lit(float(threshold))))
    numbers = F.transform(F.regexp_extract_all(clean, F.lit(r"(?U)\b([1-5](?:\.\d)?)\b"), F.lit(1)), lambda x: x.cast("double"))
    fallback = F.when(F.size(numbers) >= expected, F.slice(numbers, F.lit(1), expected)).otherwise(F.transform(places, lambda _: F.lit(float(threshold))))
    return F.when(sound, by_index).otherwise(fallback)


class LLMJudge:
    name = "llm_judge"

    def __init__(self, provider_config: dict | None = None, model: str = "", prompt_template: str = "", threshold: float = 3.0, action: str = "remove", batch_size: int = 10):
        if action not in ("remove", "flag"):
            raise ValueError(f"action is {action!r}; it must be remove or flag")
        if not provider_config and not model:
            raise ValueError("provider_config or model must be given")
        self.provider = provider_config or {"kind": "openai", "model": model}
        self.template, self.threshold, self.action, self.batch_size = prompt_template or PROMPT, threshold, action, batch_size

    def replies(self, samples: DataFrame) -> DataFrame:
        """group_no, n, seqs, reply (null if the call failed). Written once: calls are costly and never repeated by a later plan."""
        config, template = self.provider, self.template
        rows = with_seq(samples.select(F.col("seq").alias("_seq"), "text", "label"), "_seq")
        groups = rows.groupBy((F.col("seq") / self.batch_size).cast("long").alias("group_no")).agg(F.array_sort(F.collect_list(F.struct("_seq", "text", "label"))).alias("rows"))

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            provider = create_provider(config)
            for f in frames:
                out = []
                for group, items in zip(f["group_no"], f["rows"]):
                    lines = [json.dumps({k: x[k] for k in ("text", "label") if x[k] is not None}, ensure_ascii=False) for x in items]
                    prompt = template.format(samples="\n".join(f"[{i}] {x}" for i, x in enumerate(lines)))
                    try:
                        reply = provider.complete([{"role": "user", "content": prompt}], temperature=0.1).content
                    except (OSError, ValueError, RuntimeError, KeyError) as e:
                        logger.warning("scoring failed: %s", e)
                        reply = None
                    out.append((group, len(items), [x["_seq"] for x in items], reply))
                yield pd.DataFrame(out, columns=["group_no", "n", "seqs", "reply"])

        return materialize(groups.mapInPandas(ask, "group_no long, n int, seqs array<long>, reply string"), "judge-replies")

    def process(self, samples: DataFrame) -> tuple[DataFrame, StepReport]:
        scores = parse_scores(F.coalesce("reply", F.lit("")), F.col("n"), self.threshold)
        each = self.replies(samples).select(F.inline(F.arrays_zip(F.col("seqs").alias("seq"), scores.alias("_score"))))
        each = materialize(each, "judge-scores")
        n, low = each.agg(F.count("*"), F.count_if(F.col("_score") < self.threshold)).first()
        joined = samples.join(each, "seq")
        details = {"threshold": self.threshold, "mean_score": each.agg(F.avg("_score")).first()[0]}
        if self.action == "remove":
            return joined.filter(F.col("_score") >= self.threshold).drop("_score"), StepReport(self.name, n, n - low, low, 0, details)
        out = joined.withColumn("judge_score", F.when(F.col("_score") < self.threshold, F.col("_score"))).drop("_score")
        return out, StepReport(self.name, n, n, 0, low, details)

