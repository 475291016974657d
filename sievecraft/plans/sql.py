"""Pieces of DuckDB SQL that the oracles share. RE2 has neither lookaround nor Unicode \\b: borders are groups."""

from __future__ import annotations

from ..functions.lexicons import PII_CORES, PROFILE_SIZES, PROFILES, REDACTED, TOXIC

BLANK = r"[\s\pZ\x0b\x1c-\x1f\x{85}]+"
WORD = r"\pL\pN_"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def normalized(text: str = "text") -> str:
    return f"trim(regexp_replace(lower({text}), '{BLANK}', ' ', 'g'), ' ')"


def tokens(text: str = "text") -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '{BLANK}'), lambda x: x <> '')"


def pii(name: str) -> str:
    """Pattern with groups 1 and 2 for what stands around a match."""
    core = PII_CORES[name].replace(r"\d", "[0-9]")
    return quoted(f"()({core})()" if name == "email" else f"(^|[^0-9])({core})($|[^0-9])")


def redacted(text: str, names: list[str]) -> str:
    """Each pattern is applied twice: neighbours share the character between them, and the first pass takes it."""
    for n in names:
        for _ in range(2):
            text = f"regexp_replace({text}, {pii(n)}, '\\1{REDACTED}\\3', 'g')"
    return text


def pii_count(name: str, text: str = "text") -> str:
    mark = quoted(REDACTED)
    bare = f"replace({text}, {mark}, '')"
    done = redacted(bare, [name])
    return f"((length({done}) - length(replace({done}, {mark}, ''))) // {len(REDACTED)})"


def pii_hit(text: str = "text") -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {pii(n)})" for n in PII_CORES) + ")"


def toxic_word(word: str, text: str = "text") -> str:
    return f"contains(lower({text}), '{word}')" if " " in word else f"regexp_matches(lower({text}), '(^|[^{WORD}]){word}($|[^{WORD}])')"


def toxic_hit(text: str = "text") -> str:
    return "(" + " OR ".join(toxic_word(w, text) for w in TOXIC) + ")"


def language(source: str) -> str:
    """doc_id, language, confidence for the rows of source (doc_id, text)."""
    rows = ", ".join(f"({i}, '{k}', {quoted(x)})" for i, (k, v) in enumerate(PROFILES.items()) for x in v)
    sizes = ", ".join(f"('{k}', {n})" for k, n in PROFILE_SIZES.items())
    return f"""
SELECT d.doc_id, CASE WHEN length(d.text) >= 10 AND s.score > 0 THEN s.lang ELSE 'unknown' END AS language,
  CASE WHEN length(d.text) >= 10 AND s.score > 0 THEN round(s.score, 3) ELSE 0.0 END AS confidence
FROM {source} d LEFT JOIN (
  SELECT doc_id, lang, score FROM (
    SELECT t.doc_id, p.lang, p.o, count(*) / any_value(z.n) AS score
    FROM (SELECT doc_id, lower(text) AS low FROM {source}) t
    JOIN (VALUES {rows}) p(o, lang, tri) ON length(p.tri) = 3 AND contains(t.low, p.tri)
    JOIN (VALUES {sizes}) z(lang, n) ON z.lang = p.lang GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, o) = 1) s USING (doc_id)"""


def unique_documents() -> str:
    return f"(SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY {normalized()} ORDER BY doc_id) = 1)"


def similar(threshold: float) -> str:
    """CTEs up to p (a, b, jaccard) over exact-unique documents."""
    return f"""
u AS (SELECT doc_id, string_split({normalized()}, '') AS c FROM {unique_documents()}),
g AS (SELECT doc_id, CASE WHEN len(c) < 3 THEN [array_to_string(c, '')] ELSE
  list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) END AS grams FROM u),
e AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
  FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id AND a.n >= {threshold} * b.n AND b.n >= {threshold} * a.n
  GROUP BY a.doc_id, b.doc_id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= {threshold})"""
