"""Step reports: one row of a metrics table per curation step."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "step_no int, name string, input_count long, output_count long, removed long, flagged long, details string"


@dataclass
class StepReport:
    name: str
    input_count: int
    output_count: int
    removed: int
    flagged: int = 0
    details: dict[str, Any] = field(default_factory=dict)


class QualityStep(Protocol):
    """A step takes samples with a seq column and returns samples and its report."""

    name: str

    def process(self, samples: DataFrame) -> tuple[DataFrame, StepReport]: ...


@dataclass
class QualityReport:
    input_count: int = 0
    output_count: int = 0
    steps: list[StepReport] = field(default_factory=list)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s.name, s.input_count, s.output_count, s.removed, s.flagged, json.dumps(s.details, sort_keys=True, ensure_ascii=False)) for i, s in enumerate(self.steps)]
        return spark.createDataFrame(rows, SCHEMA)
