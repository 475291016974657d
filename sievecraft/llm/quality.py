"""Quality rules, line first: lines that fail are removed, then documents that lost too much are rejected."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents

NAVIGATION = ("skip to content", "click here", "read more", "back to top", "sign in", "log in", "next page", "previous page", "share this", "subscribe to our", "main menu", "site map")
BOILERPLATE = ("all rights reserved", "licensed under", "released under the", "cookie policy", "privacy policy", "terms of use", "terms of service", "lorem ipsum", "enable javascript", "copyright (c)", "copyright ©")
_BLANK = " \t\r"
#: What a sentence may end in, and full stops of scripts that put no space after them.
_FULL_STOPS = "。．｡।॥۔።։។။།"
_ENDS = ".!?:;…\"'”’»)" + _FULL_STOPS + "！？：；」』）】》〉〕｣؟؛፧៕׃"


@dataclass(frozen=True)
class Rules:
    """max_loss: share of a document's text that its failing lines may hold; beyond it the document goes.

    phrase_share: what phrases or separators hold of a failing line that is longer than short characters.
    """

    max_loss: float = 0.5
    marks: int = 4  # so many marks, and
    mark_share: float = 0.12  # this share of a line, are too many
    separators: int = 3
    phrase_share: float = 0.05
    short: int = 100
    repeat_words: int = 8
    repeat_share: float = 0.3


def _bounded(phrase: str) -> str:
    """A pattern of the phrase that doesn't begin or end inside a word."""
    before, after = ("[\\p{L}\\p{N}_]" if c.isalnum() else "" for c in (phrase[0], phrase[-1]))
    return (before and f"(?<!{before})") + re.escape(phrase) + (after and f"(?!{after})")


_PHRASES = "|".join(map(_bounded, NAVIGATION + BOILERPLATE))


def line_fails(line: Column, low: Column, rules: Rules = Rules()) -> Column:
    """Whether a trimmed line that isn't blank, in lower case low, breaks a rule.

    Punctuation: no sentence ends in it (scripts without sentence marks, like Thai, fail), or it is full
    of marks. Navigation: separators or a phrase of menus. Boilerplate: a phrase of notices, or few words over and over.
    Phrases stand between word borders; in a long line phrases and separators must hold their share of it.
    """
    words = F.split(line, " ")
    marks = F.length(F.regexp_replace(line, "[^!?#$%&*|<>{}~^=_@/]", ""))
    unended = ~F.right(line, F.lit(1)).isin(*_ENDS) & ~F.contains(line, F.lit(". ")) & ~F.rlike(line, F.lit(f"[{_FULL_STOPS}]"))
    dense = (marks >= rules.marks) & (marks > rules.mark_share * F.length(line))
    bars = F.length(line) - F.length(F.replace(line, F.lit(" | "), F.lit("  ")))
    barred = (bars >= rules.separators) & ((F.length(line) <= rules.short) | (bars * 3 >= rules.phrase_share * F.length(line)))
    gate = F.lit(False)  # much cheaper than the pattern
    for phrase in NAVIGATION + BOILERPLATE:
        gate |= F.contains(low, F.lit(phrase))
    held = F.length(low) - F.length(F.regexp_replace(low, _PHRASES, ""))
    menu = gate & (held > 0) & ((F.length(low) <= rules.short) | (held >= rules.phrase_share * F.length(low)))
    n = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    again = (n >= rules.repeat_words) & (F.size(F.array_distinct(words)) < rules.repeat_share * n)
    return unended | dense | barred | menu | again


def apply_rules(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Documents that stay, all columns, with text cleaned and n_chars (if there) counted again.

    Lines end at \\n and are judged without spaces, tabs and \\r at their ends; blank lines neither fail nor count.
    A document is rejected if failing lines hold more than max_loss of the characters of its trimmed lines, or if
    no text is left: so null, empty and blank texts go. Repeated rows are judged alike. An empty table gives an empty one. Other columns pass unchanged.
    All is per row: no shuffle, no Python.
    """
    t = _judged(docs, rules)
    out = t.filter((F.col("__sc_q.kept") > 0) & (F.col("__sc_q.all") - F.col("__sc_q.kept") <= rules.max_loss * F.col("__sc_q.all")))
    keep = [F.col("__sc_q.text").alias(c) if c == "text" else F.length("__sc_q.text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*keep)


def _judged(docs: DataFrame, rules: Rules) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("raw"), F.trim(x, F.lit(_BLANK)).alias("line"), F.lower(F.trim(x, F.lit(_BLANK))).alias("low")))
    kept = F.filter(F.col("__sc_lines"), lambda x: (x["line"] == "") | ~line_fails(x["line"], x["low"], rules))

    def chars(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda s, y: s + F.length(y["line"]))

    # an array that is exploded from one element keeps each step computed once
    one = docs.filter(F.col("text").isNotNull()).withColumn("__sc_lines", F.explode(F.array(lines))).withColumn("__sc_kept", F.explode(F.array(kept)))
    return one.withColumn(
        "__sc_q",
        F.struct(
            F.array_join(F.transform("__sc_kept", lambda x: x["raw"]), "\n").alias("text"),
            chars(F.col("__sc_lines")).alias("all"),
            chars(F.col("__sc_kept")).alias("kept"),
            (F.size("__sc_lines") - F.size("__sc_kept")).alias("removed"),
        ),
    )


def quality_report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """doc_id, text, n_removed (lines) of the documents that stay."""
    t = _judged(docs.select("doc_id", "text"), rules)
    q = F.col("__sc_q")
    return t.filter((q["kept"] > 0) & (q["all"] - q["kept"] <= rules.max_loss * q["all"])).select("doc_id", q["text"].alias("text"), q["removed"].alias("n_removed"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir))


def _sql(rules: Rules = Rules()) -> str:
    quoted = "'.','!','?',':',';','…','\"','''','”','’','»',')'"
    phrases = " OR ".join(f"contains(lower(trim(x, ' ')), '{p}')" for p in NAVIGATION + BOILERPLATE)
    marks = "length(regexp_replace(trim(x, ' '), '[^!?#$%&*|<>{}~^=_@/]', '', 'g'))"
    line = "trim(x, ' ')"
    words = f"string_split({line}, ' ')"
    fails = (
        f"((right({line}, 1) NOT IN ({quoted}) AND NOT contains({line}, '. ')) OR ({marks} >= {rules.marks} AND {marks} > {rules.mark_share} * length({line}))"
        f" OR length({line}) - length(replace({line}, ' | ', '  ')) >= {rules.separators} OR {phrases}"
        f" OR (len({words}) >= {rules.repeat_words} AND len(list_distinct({words})) < {rules.repeat_share} * len({words})))"
    )
    return f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, lines, list_filter(lines, lambda x: {line} = '' OR NOT {fails}) AS kept FROM l),
c AS (SELECT *, list_sum(list_transform(lines, lambda x: length({line}))) AS n_all,
  coalesce(list_sum(list_transform(kept, lambda x: length({line}))), 0) AS n_kept FROM k)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, (len(lines) - len(kept))::INT AS n_removed
FROM c WHERE n_kept > 0 AND n_all - n_kept <= {rules.max_loss} * n_all"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {"op9_quality_rules": _sql()}
