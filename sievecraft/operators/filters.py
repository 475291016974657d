"""Row filters and detectors as native expressions: lengths and labels, personal data, toxic words, language."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import PII, PROFILE_SIZES, PROFILES, REDACTED, TOXIC
from ..storage import materialize, spread
from .report import StepReport


def validate_samples(samples: DataFrame, min_length: int = 10, max_length: int = 10_000, allowed_labels: Sequence[str] | None = None) -> DataFrame:
    """Rows of min_length to max_length characters whose label, if any, is allowed."""
    keep = F.length("text").between(min_length, max_length)
    if allowed_labels:
        keep &= F.coalesce(F.col("label"), F.lit("")).isin("", *allowed_labels)
    return samples.filter(keep)


def _action(action: str, known: tuple[str, ...]) -> str:
    if action not in known:
        raise ValueError(f"action is {action!r}; it must be one of {', '.join(known)}")
    return action


class PIIFilter:
    """Personal data in text: flag it (pii_detected), redact it (pii_redacted) or remove the row."""

    name = "pii"

    def __init__(self, action: str = "flag", patterns: Sequence[str] | None = None):
        self.action = _action(action, ("flag", "redact", "remove"))
        if unknown := set(patterns or ()) - set(PII):
            raise ValueError(f"unknown patterns of personal data: {sorted(unknown)}")
        self.patterns = {k: v for k, v in PII.items() if patterns is None or k in patterns}

    def gate(self, text: Column, name: str) -> Column:
        """Whether text holds what every match of a pattern holds, which is much cheaper to look for."""
        return F.contains(text, F.lit("@")) if name == "email" else F.rlike(text, F.lit(r"\p{Nd}"))

    def counts(self, text: Column) -> dict[str, Column]:
        return {k: F.when(self.gate(text, k), F.regexp_count(text, F.lit(v))).otherwise(0) for k, v in self.patterns.items()}

    def detected(self, text: Column) -> Column:
        """Names of the patterns found, in their order."""
        none = F.lit(None).cast("string")
        return F.array_compact(F.array(*[F.when(self.gate(text, k) & F.rlike(text, F.lit(v)), F.lit(k)).otherwise(none) for k, v in self.patterns.items()]))

    def redacted(self, text: Column) -> Column:
        gate, out = F.lit(False), text
        for k, v in self.patterns.items():
            gate |= self.gate(text, k)
            out = F.regexp_replace(out, v, REDACTED)
        return F.when(gate, out).otherwise(text)

    def process(self, samples: DataFrame) -> tuple[DataFrame, StepReport]:
        found = self.counts(F.col("text"))
        # the patterns run once per row: counts, flags and removal read what is written here
        seen = materialize(spread(samples).withColumn("__pii", F.struct(*[v.alias(k) for k, v in found.items()])), "pii")
        each = {k: F.col("__pii")[k] for k in found}
        hit = sum(each.values(), F.lit(0)) > 0
        row = seen.agg(F.count("*").alias("n"), F.count_if(hit).alias("hit"), *[F.sum(v).alias(k) for k, v in each.items()]).first()
        counts = {k: row[k] for k in found if row[k]}
        out, removed, flagged = seen, 0, 0
        if self.action == "remove":
            out, removed = seen.filter(~hit), row["hit"]
        elif self.action == "flag":
            names = F.array_compact(F.array(*[F.when(v > 0, F.lit(k)) for k, v in each.items()]))
            out, flagged = seen.withColumn("pii_detected", F.when(hit, names)), row["hit"]
        else:
            out = seen.withColumn("pii_redacted", F.when(hit, F.lit(True))).withColumn("text", F.when(hit, self.redacted(F.col("text"))).otherwise(F.col("text")))
        return out.drop("__pii"), StepReport(self.name, row["n"], row["n"] - removed, removed, flagged, {"pii_counts": counts})


class ToxicityFilter:
    """Toxic keywords: flag them (toxic_keywords) or remove the row. Single words match whole, phrases anywhere.

    An empty keyword list matches every text, with the keyword "".
    """

    name = "toxicity"

    def __init__(self, method: str = "keywords", action: str = "flag", keywords: Sequence[str] | None = None):
        if method != "keywords":
            raise ValueError(f"method is {method!r}; only 'keywords' is known")
        self.action = _action(action, ("flag", "remove"))
        words = TOXIC if keywords is None else list(keywords)
        self.words = words
        parts = [re.escape(w) if " " in w else rf"\b{re.escape(w)}\b" for w in words]
        self.pattern = "(?iuU)" + "|".join(parts)

    def hit(self, text: Column) -> Column:
        """Whether text matches; false for null. Texts that hold no keyword in lower case skip the pattern, unless they hold
        one of the four characters outside ASCII that it takes for an ASCII letter."""
        low, gate = F.lower(text), F.lit(False)
        for w in dict.fromkeys(w.lower() for w in self.words):
            gate |= F.contains(low, F.lit(w))
        for c in "\u017f\u0131\u0130\u212a":
            gate |= F.contains(text, F.lit(c))
        if not all(w.isascii() for w in self.words):
            gate = F.lit(True)
        return F.coalesce(gate & F.rlike(text, F.lit(self.pattern)), F.lit(False)) if self.words else text.isNotNull()

    def found(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def matches(self, text: Column) -> Column:
        """Sorted distinct matches in lower case."""
        none = F.array().cast("array<string>")
        return F.when(self.hit(text), F.array_sort(F.array_distinct(F.transform(self.found(text), F.lower)))).otherwise(F.when(text.isNotNull(), none))

    def process(self, samples: DataFrame) -> tuple[DataFrame, StepReport]:
        text = F.col("text")
        seen = materialize(spread(samples).withColumn("__toxic", F.when(self.hit(text), F.transform(self.found(text), F.lower))), "toxicity")
        hit = F.col("__toxic").isNotNull()
        n, hits, total = seen.agg(F.count("*"), F.count_if(hit), F.sum(F.when(hit, F.size("__toxic")))).first()
        details = {"total_matches": total or 0}
        if self.action == "remove":
            return seen.filter(~hit).drop("__toxic"), StepReport(self.name, n, n - hits, hits, 0, details)
        return seen.withColumn("toxic_keywords", F.array_sort(F.array_distinct("__toxic"))).drop("__toxic"), StepReport(self.name, n, n, 0, hits, details)


#: Entries of each profile that can match, and the confidence that a number of them gives.
_LIVE = [(k, [x for x in v if len(x) == 3]) for k, v in PROFILES.items() if any(len(x) == 3 for x in v)]
_CONFIDENCE = {k: [float(Decimal(repr(i / PROFILE_SIZES[k])).quantize(Decimal("0.001"), ROUND_HALF_UP)) for i in range(len(v) + 1)] for k, v in _LIVE}


def _language(text: str | None) -> tuple[str, float]:
    if text is None or len(text) < 10:
        return "unknown", 0.0
    low, best, found = text.lower(), 0.0, ("unknown", 0.0)
    for name, entries in _LIVE:
        n = sum(x in low for x in entries)
        if n / PROFILE_SIZES[name] > best:
            best, found = n / PROFILE_SIZES[name], (name, _CONFIDENCE[name][n])
    return found


def detect_language(text: Column) -> Column:
    """struct(language, confidence): the profile with the largest share of its entries in the text, the first of
    equal ones; unknown and 0.0 for a text of under ten characters or without any entry.

    Some two hundred searches a text, of which most end early: in Arrow batches several times faster than natively.
    """

    @F.pandas_udf("language string, confidence double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_language(t) for t in texts], columns=["language", "confidence"])

    return run(text)


class LanguageFilter:
    """Rows whose detected language isn't the expected one are removed, or flagged with language and confidence."""

    name = "language"

    def __init__(self, expected: str = "en", action: str = "remove"):
        self.expected, self.action = expected, _action(action, ("remove", "flag"))

    def process(self, samples: DataFrame) -> tuple[DataFrame, StepReport]:
        # one detection per row, written once
        seen = materialize(spread(samples).withColumn("_lang", detect_language(F.coalesce("text", F.lit("")))), "languages")
        found = {r[0]: r[1] for r in seen.groupBy("_lang.language").count().collect()}  # ten languages at most
        n, good = sum(found.values()), found.get(self.expected, 0)
        details = {"language_distribution": found}
        match = F.col("_lang.language") == self.expected
        if self.action == "remove":
            return seen.filter(match).drop("_lang"), StepReport(self.name, n, good, n - good, 0, details)
        out = seen.withColumns({"detected_language": F.when(~match, F.col("_lang.language")), "language_confidence": F.when(~match, F.col("_lang.confidence"))}).drop("_lang")
        return out, StepReport(self.name, n, n, 0, n - good, details)
