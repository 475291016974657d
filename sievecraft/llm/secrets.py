"""Secret scans with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, new_path, stored


@dataclass(frozen=True)
class Rule:
    """gate: a string that every match holds, in lower case; texts without it skip the pattern."""

    name: str
    gate: str
    pattern: str

    @property
    def version(self) -> str:
        return hashlib.sha256(f"{self.name}\0{self.gate}\0{self.pattern}".encode()).hexdigest()[:16]


_ASSIGNED = "[\"']?[ \t]*[:=][ \t]*[\"']?[A-Za-z0-9+/_=-]{12,}[\"']?"
_BEGIN = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
_GAP = r"""(?:\\[rnt]|[\s"',>#\\])"""  # between a key's lines, also escaped or quoted
#: From BEGIN through END without another line of five dashes; where END is missing, header fields and lines of base64.
#: Repeats have bounds that no key reaches, since Java recurses for each.
_PRIVATE_KEY = (
    _BEGIN + r"(?:[^-]*+(?:-{1,4}+(?!-)[^-]*+){0,64}?-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}{{0,10}}+[A-Z][A-Za-z]*-[A-Z][A-Za-z]*: ?[A-Za-z0-9,-]++){{0,4}}"
    rf"(?:(?:{_GAP}{{0,10}}+[A-Za-z0-9+/=]{{20,}}+){{1,1000}}(?:{_GAP}{{1,10}}+(?=[A-Za-z]*[0-9+/=])[A-Za-z0-9+/]*={{0,2}})?)?)"
)
RULES = (
    Rule("aws_access_key", "akia", "AKIA[0-9A-Z]{16}"),
    Rule("github_token", "gh", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack_token", "xox", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe_key", "sk_live_", "sk_live_[0-9A-Za-z]{24,}"),
    Rule("google_key", "aiza", "AIza[0-9A-Za-z_-]{35}"),
    Rule("json_web_token", "eyj", "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
    Rule("private_key", "private key", _PRIVATE_KEY),
    Rule("password", "passw", "[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]" + _ASSIGNED),
    Rule("token", "token", "[Tt][Oo][Kk][Ee][Nn]" + _ASSIGNED),
    Rule("secret", "secret", "[Ss][Ee][Cc][Rr][Ee][Tt]" + _ASSIGNED),
    Rule("api_key", "api", "[Aa][Pp][Ii][_-]?[Kk][Ee][Yy]" + _ASSIGNED),
)
_FINDINGS = "blob string, rule string, version string, secret_sha256 string, n_matches long"
_LEDGER = "blob string, version string"


class Ledger:
    """Two tables in a folder: scanned (blob, version) pairs, and findings by blob."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "blob-ledger")

    def read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(path) if stored(self.spark, path) else self.spark.createDataFrame([], schema)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> int:
        """Scan the (blob, rule version) pairs of docs that aren't in the ledger; returns how many blobs were.

        Findings are appended before the pairs: a run that dies between leaves findings that are scanned and
        appended again, and findings() reads them as a set.
        """
        versions = F.array(*[F.lit(r.version) for r in rules])
        seen = self.read("scanned", _LEDGER).groupBy("blob").agg(F.collect_set("version").alias("seen"))
        blobs = docs.filter(F.col("text").isNotNull()).select(address(F.col("text")).alias("blob"), "text").groupBy("blob").agg(F.first("text").alias("text"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(versions, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("todo") > 0)
        low = todo.withColumn("low", F.explode(F.array(F.lower("text"))))
        none = F.array().cast("array<string>")

        def matches(r: Rule) -> Column:
            found = F.when(F.array_contains("todo", r.version) & F.contains("low", F.lit(r.gate)), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none)
            return F.transform(found, lambda s: F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.sha2(s, 256).alias("secret_sha256")))

        hits = F.flatten(F.array(*map(matches, rules)))
        new = low.select("blob", "todo", hits.alias("hits"))
        path = f"{self.path}/runs/{new_path(self.spark, 'run').rpartition('-')[2]}"
        new.write.parquet(path)  # scanned once, used for both tables
        new = self.spark.read.parquet(path)
        new.select("blob", F.explode("hits").alias("h")).groupBy("blob", "h.rule", "h.version", "h.secret_sha256").agg(F.count("*").alias("n_matches")).write.mode("append").parquet(f"{self.path}/findings")
        new.select("blob", F.explode("todo").alias("version")).write.mode("append").parquet(f"{self.path}/scanned")
        return new.count()

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        return self.read("findings", _FINDINGS).filter(F.col("version").isin(*[r.version for r in rules])).dropDuplicates(["blob", "rule", "version", "secret_sha256"])


def address(text: Column) -> Column:
    return F.sha2(text, 256)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, blob, rule, secret_sha256, n_matches: what the rules find, for every path that holds the blob.

    Each row of docs is one version of path doc_id. Equal texts are one blob and are scanned once; repeated
    rows (same id and text) give one set of findings. Null texts have no blob and no findings; a null doc_id is a
    path like any other. An empty table gives an empty result. Other columns aren't read.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, rules)
    paths = docs.filter(F.col("text").isNotNull()).select("doc_id", address(F.col("text")).alias("blob")).distinct()
    return paths.join(ledger.findings(rules), "blob").select("doc_id", "blob", "rule", "secret_sha256", "n_matches")


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: Ledger | None = None) -> DataFrame:
    """docs, all columns and rows, each secret in text replaced by [rule name]; n_chars (if there) counted again.

    Only texts whose blob has findings are rewritten; null, empty and clean texts stay as they are. Repeated rows are all
    returned and rewritten alike, null ids like any other; an empty table gives an empty one; other columns pass unchanged.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, rules)
    bad = ledger.findings(rules).groupBy(F.col("blob").alias("__sc_blob")).agg(F.lit(True).alias("__sc_bad"))
    clean = F.col("text")
    for r in sorted(rules, key=lambda r: r.name != "private_key"):  # first, before a rule breaks a key's characters
        clean = F.regexp_replace(clean, r.pattern, f"[{r.name}]")
    t = docs.withColumn("__sc_blob", address(F.col("text"))).join(bad, "__sc_blob", "left")
    text = F.when(F.col("__sc_bad"), clean).otherwise(F.col("text"))
    return t.select(*[text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def _sql() -> str:
    pattern = lambda r: _BEGIN if r.name == "private_key" else r.pattern  # noqa: E731  # RE2 knows no lookahead
    quote = lambda s: s.replace("'", "''")
    parts = [f"SELECT doc_id, sha256(text) AS blob, '{r.name}' AS rule, unnest(regexp_extract_all(text, '{quote(pattern(r))}')) AS s FROM (SELECT DISTINCT doc_id, text FROM documents)" for r in RULES]
    return f"WITH f AS ({' UNION ALL '.join(parts)}) SELECT doc_id, blob, rule, sha256(s) AS secret_sha256, count(*) AS n_matches FROM f GROUP BY ALL"


QUERIES = {"op4_secret_scans": op4_secret_scans}
ORACLES = {"op4_secret_scans": _sql()}
