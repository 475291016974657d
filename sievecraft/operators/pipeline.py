"""Quality steps in sequence, built from configuration."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame

from .filters import LanguageFilter, PIIFilter, ToxicityFilter
from .judge import LLMJudge
from .metrics import BalanceChecker, DiversityReporter
from .report import QualityReport, QualityStep

logger = logging.getLogger(__name__)
STEPS: dict[str, Callable[..., QualityStep]] = {
    "pii": PIIFilter,
    "language": LanguageFilter,
    "toxicity": ToxicityFilter,
    "balance": BalanceChecker,
    "diversity": DiversityReporter,
    "llm_judge": LLMJudge,
}


def run_steps(samples: DataFrame, steps: Sequence[QualityStep]) -> tuple[DataFrame, QualityReport]:
    report = QualityReport()
    for step in steps:
        samples, one = step.process(samples)
        report.steps.append(one)
    if report.steps:
        report.input_count, report.output_count = report.steps[0].input_count, report.steps[-1].output_count
    else:
        report.input_count = report.output_count = samples.count()
    return samples, report


def build_steps(config: Sequence[dict[str, dict[str, Any] | None]]) -> list[QualityStep]:
    """One step for each {name: keywords}; unknown names are left out with a warning."""
    out = []
    for entry in config:
        for name, own in entry.items():
            if name not in STEPS:
                logger.warning("no quality step is named %s", name)
                continue
            out.append(STEPS[name](**(own or {})))
    return out
