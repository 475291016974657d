"""One query per operator over the given tables, with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..card import SIZES, generate_card, size_category_column
from ..functions import text as T
from ..functions.lexicons import PII_CORES, TOXIC
from ..generation.engine import PRICES, Checkpoint, curate, estimate_run, parse_replies
from ..generation.strategies import DEPTHS, EVOLUTIONS, MODES, PERSONAS, create_strategy
from ..generation.tasks import alternates, create_task
from ..operators import metrics
from ..operators.chunking import chunk_text
from ..operators.dedup import deduplicate, exact_dedup, similar_pairs
from ..operators.filters import PIIFilter, ToxicityFilter, detect_language, validate_samples
from ..operators.judge import parse_scores
from ..operators.pipeline import build_steps, run_steps
from ..operators.retrieval import retrieve
from ..sinks import StreamingWriter, alpaca, csv_columns, export, openai, records, sharegpt, write_csv, write_huggingface, write_lines, write_parquet
from ..sources.documents import extract_html, load_documents
from ..sources.samples import read_csv, read_jsonl, read_samples, samples_of, with_seq
from ..storage import Output, shared_folder, spread
from ..streaming.samples import read_stream, validated, write_available
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """documents as samples, with lang as label."""
    return samples_of(_table(spark, d, "documents"), "doc_id", "text", "lang")


def _graded(spark: SparkSession, d: str) -> DataFrame:
    """documents as samples, with the quality of labels as label; null where there is none."""
    q = _table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return samples_of(_table(spark, d, "documents").select("doc_id", "text").join(q, "doc_id", "left"), "doc_id", "text", "quality")


def _id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("seq", "doc_id")


# --- filters and dedup ---


@query(f"""
WITH k AS (SELECT * FROM {S.unique_documents()} WHERE length(text) BETWEEN 10 AND 10000)
SELECT lang AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY lang""")
def curated_labels(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: exact dedup, length validation, label distribution."""
    kept = validate_samples(exact_dedup(_docs(spark, d)))
    return metrics.label_distribution(kept).select("label", "n", F.round("share", 6).alias("share"))


@query("SELECT doc_id, lang AS label FROM documents WHERE length(text) BETWEEN 10 AND 10000 AND lang IN ('en', 'fr', '')")
def validate_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _id(validate_samples(_docs(spark, d), allowed_labels=["en", "fr"])).select("doc_id", "label")


@query(f"SELECT doc_id FROM {S.unique_documents()}")
def exact_dedup_documents(spark: SparkSession, d: str) -> DataFrame:
    return _id(exact_dedup(_docs(spark, d))).select("doc_id")


@query(f"WITH {S.similar(0.85)} SELECT a, b, round(jaccard, 6) AS jaccard FROM p")
def fuzzy_dedup_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(exact_dedup(_docs(spark, d))).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query(f"""
WITH RECURSIVE {S.similar(0.85)},
l AS MATERIALIZED (SELECT b, list(a) AS near, row_number() OVER (ORDER BY b) AS i FROM p GROUP BY b),
r(i, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT l.i, CASE WHEN len(list_filter(l.near, lambda x: NOT list_contains(r.gone, x))) > 0 THEN list_append(r.gone, l.b) ELSE r.gone END
  FROM r JOIN l ON l.i = r.i + 1)
SELECT doc_id FROM {S.unique_documents()} WHERE doc_id NOT IN (SELECT unnest(gone) FROM r WHERE i = (SELECT max(i) FROM r))""")
def fuzzy_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _id(deduplicate(_docs(spark, d))).select("doc_id")


# --- personal data, toxic words, language ---


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(text, {S.pii(n)}) THEN '{n}' END" for n in PII_CORES)}], lambda x: x IS NOT NULL), ',') AS detected FROM documents WHERE {S.pii_hit()}")
def pii_flag(spark: SparkSession, d: str) -> DataFrame:
    names = PIIFilter("flag").detected(F.col("text"))
    return _id(spread(_docs(spark, d))).select("doc_id", F.array_join(names, ",").alias("detected")).filter("detected <> ''")


@query(f"SELECT doc_id, {S.redacted('text', list(PII_CORES))} AS text FROM documents")
def pii_redact(spark: SparkSession, d: str) -> DataFrame:
    return _id(spread(_docs(spark, d))).select("doc_id", PIIFilter("redact").redacted(F.col("text")).alias("text"))


@query(f"SELECT doc_id FROM documents WHERE NOT {S.pii_hit()}")
def pii_remove(spark: SparkSession, d: str) -> DataFrame:
    return _id(spread(_docs(spark, d))).filter(F.size(PIIFilter("remove").detected(F.col("text"))) == 0).select("doc_id")


@query(" UNION ALL ".join(f"SELECT '{n}' AS pattern, sum({S.pii_count(n)})::BIGINT AS n FROM documents" for n in PII_CORES))
def pii_counts(spark: SparkSession, d: str) -> DataFrame:
    c = PIIFilter().counts(F.col("text"))
    sums = spread(_docs(spark, d)).agg(*[F.sum(v).cast("long").alias(k) for k, v in c.items()])
    return sums.unpivot([], list(c), "pattern", "n")


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {S.toxic_word(w)} THEN '{w}' END" for w in TOXIC)}], lambda x: x IS NOT NULL)), ',') AS keywords FROM documents WHERE {S.toxic_hit()}")
def toxicity_flag(spark: SparkSession, d: str) -> DataFrame:
    words = ToxicityFilter().matches(F.col("text"))
    return _id(spread(_docs(spark, d))).select("doc_id", F.array_join(words, ",").alias("keywords")).filter("keywords <> ''")


@query(f"SELECT doc_id FROM documents WHERE NOT {S.toxic_hit()}")
def toxicity_remove(spark: SparkSession, d: str) -> DataFrame:
    return _id(spread(_docs(spark, d))).filter(~ToxicityFilter().hit(F.col("text")) & F.col("text").isNotNull()).select("doc_id")


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter([{', '.join(f"CASE WHEN {S.toxic_word(w)} THEN '{w}' END" for w in ('the', 'und', 'de la'))}], lambda x: x IS NOT NULL)), ',') AS keywords FROM documents")
def keyword_flag(spark: SparkSession, d: str) -> DataFrame:
    """The keyword filter with keywords that these texts hold: two words and a phrase."""
    words = ToxicityFilter(keywords=["the", "und", "de la"]).matches(F.col("text"))
    return _id(spread(_docs(spark, d))).select("doc_id", F.array_join(words, ",").alias("keywords"))


@query(S.language("documents"))
def detect_languages(spark: SparkSession, d: str) -> DataFrame:
    return _id(spread(_docs(spark, d))).select("doc_id", detect_language(F.col("text")).alias("l")).select("doc_id", "l.*")


@query(f"SELECT doc_id FROM ({S.language('documents')}) WHERE language = 'fr'")
def language_filter(spark: SparkSession, d: str) -> DataFrame:
    return _id(spread(_docs(spark, d)).withColumn("l", detect_language(F.col("text"))["language"]).filter("l = 'fr'")).select("doc_id")


@query(f"SELECT language, count(*) AS n FROM ({S.language('documents')}) GROUP BY language")
def language_distribution(spark: SparkSession, d: str) -> DataFrame:
    return spread(_docs(spark, d)).groupBy(detect_language(F.col("text"))["language"].alias("language")).agg(F.count("*").alias("n"))


# --- metrics ---


@query("SELECT lang AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_distribution(_docs(spark, d)).select("label", "n", F.round("share", 6).alias("share"))


@query("SELECT round(entropy(source), 4) AS entropy FROM documents")
def label_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).agg(metrics.entropy(F.col("n")).alias("entropy"))


@query('SELECT round(avg(length(text)), 1) AS mean, min(length(text)) AS "min", max(length(text)) AS "max", round(stddev_samp(length(text)), 1) AS std FROM documents')
def length_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.length_stats(_docs(spark, d))


@query(f"WITH t AS (SELECT unnest({S.tokens()}) AS w FROM documents) SELECT count(DISTINCT w) AS vocabulary_size, count(*) AS total_tokens, round(count(DISTINCT w) / count(*), 4) AS type_token_ratio FROM t")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.vocabulary(_docs(spark, d))


@query(f"""
WITH t AS (SELECT doc_id, {S.tokens()} AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS pos FROM t),
g AS (SELECT w AS g1, w || ' ' || lead(w) OVER o AS g2, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g3 FROM e WINDOW o AS (ORDER BY doc_id, pos))
SELECT 1 AS n, count(g1) AS total, count(DISTINCT g1) AS "distinct", round(count(DISTINCT g1) / count(g1), 4) AS ratio FROM g
UNION ALL SELECT 2, count(g2), count(DISTINCT g2), round(count(DISTINCT g2) / count(g2), 4) FROM g
UNION ALL SELECT 3, count(g3), count(DISTINCT g3), round(count(DISTINCT g3) / count(g3), 4) FROM g""")
def distinct_n(spark: SparkSession, d: str) -> DataFrame:
    return metrics.distinct_ngrams(_docs(spark, d))


@query(f"""
WITH c AS (SELECT *, md5('42:' || doc_id) AS mark FROM documents ORDER BY mark, doc_id LIMIT 100),
t AS (SELECT {S.tokens()} AS t, row_number() OVER (ORDER BY mark, doc_id) AS i, count(*) OVER () AS n FROM c),
p AS (SELECT a.t AS ref, b.t AS hyp FROM t a JOIN t b ON b.i = a.i % a.n + 1 WHERE a.i <= 50 AND a.n >= 4),
s AS (SELECT CASE WHEN len(ref) = 0 OR len(hyp) = 0 THEN 0 ELSE
  coalesce(list_sum(list_transform(list_distinct(hyp), lambda x: least(len(list_filter(ref, lambda y: y = x)), len(list_filter(hyp, lambda z: z = x))))), 0) / len(hyp) END AS s FROM p)
SELECT count(*) AS n_pairs, round(avg(s), 4) AS self_bleu FROM s""")
def self_bleu(spark: SparkSession, d: str) -> DataFrame:
    return metrics.self_bleu(_docs(spark, d))


@query("""
WITH c AS (SELECT quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality)
SELECT count(*) AS n_labels, min(n) AS min_count, max(n) AS max_count, round(max(n) / min(n), 2) AS ratio, max(n) / min(n) > 1.2 AS imbalanced FROM c""")
def balance_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.balance_report(_graded(spark, d), 1.2)


@query("""
WITH g AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT min(n) AS low FROM (SELECT count(*) AS n FROM g WHERE quality IS NOT NULL GROUP BY quality))
SELECT doc_id, quality::VARCHAR AS label FROM g, c
QUALIFY quality IS NULL OR row_number() OVER (PARTITION BY quality ORDER BY doc_id) <= low""")
def balance_undersample(spark: SparkSession, d: str) -> DataFrame:
    s = _graded(spark, d)
    cap = metrics.balance_report(s, 1.0).first()["min_count"] or 0
    return _id(metrics.undersample(s, cap)).select("doc_id", "label")


@query(f"""
SELECT 'count' AS metric, count(*)::DOUBLE AS value FROM documents
UNION ALL SELECT 'num_labels', count(DISTINCT lang) FROM documents
UNION ALL SELECT 'label_entropy', round(entropy(lang), 4) FROM documents
UNION ALL SELECT 'label_' || lang, count(*) FROM documents GROUP BY lang
UNION ALL SELECT 'length_' || k, v FROM (SELECT unnest(['mean', 'min', 'max', 'std']) AS k, unnest([mean, "min", "max", std]) AS v FROM ({ORACLES["length_stats"]}))
UNION ALL SELECT unnest(['vocabulary_size', 'total_tokens', 'type_token_ratio']), unnest([vocabulary_size, total_tokens, type_token_ratio]) FROM ({ORACLES["vocabulary"]})
UNION ALL SELECT 'distinct_' || n, ratio FROM ({ORACLES["distinct_n"]})
UNION ALL SELECT 'self_bleu', self_bleu FROM ({ORACLES["self_bleu"]})""")
def evaluate_dataset(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.evaluate_dataset(_docs(spark, d))
    flat = {f"length_{k}": v for k, v in m.pop("text_length").items()} | {f"label_{k}": v for k, v in m.pop("label_distribution").items()} | m
    return spark.createDataFrame([(k, float(v)) for k, v in flat.items()], "metric string, value double")


@query(f"""
WITH a AS (SELECT doc_id, text FROM documents WHERE NOT {S.pii_hit()}), l AS ({S.language('a')}),
b AS (SELECT a.* FROM a JOIN l USING (doc_id) WHERE language = 'en'), t AS (SELECT * FROM b WHERE {S.toxic_hit()})
SELECT 0 AS step_no, 'pii' AS name, (SELECT count(*) FROM documents) AS input_count, (SELECT count(*) FROM a) AS output_count, 0::BIGINT AS flagged
UNION ALL SELECT 1, 'language', (SELECT count(*) FROM a), (SELECT count(*) FROM b), 0
UNION ALL SELECT 2, 'toxicity', (SELECT count(*) FROM b), (SELECT count(*) FROM b), (SELECT count(*) FROM t)""")
def quality_pipeline_report(spark: SparkSession, d: str) -> DataFrame:
    steps = build_steps([{"pii": {"action": "remove"}}, {"language": {"expected": "en"}}, {"toxicity": None}, {"unknown": {}}])
    _, report = run_steps(_docs(spark, d), steps)
    return report.to_frame(spark).select("step_no", "name", "input_count", "output_count", "flagged")


# --- retrieval, chunks, loaders ---


@query(f"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[{S.WORD}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln(any_value(n.n) / count(*)) AS idf FROM tf, n GROUP BY term HAVING count(*) < any_value(n.n)),
v AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc_id),
qw AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[{S.WORD}]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) * any_value(idf) AS q FROM qw JOIN idf USING (term) GROUP BY ALL),
qn AS (SELECT item_id, sqrt(sum(q * q)) AS qnorm FROM q GROUP BY item_id),
s AS (SELECT item_id, doc_id, sum(q * w) AS dot FROM q JOIN v USING (term) GROUP BY ALL),
r AS (SELECT b.item_id, d.doc_id, coalesce(round(dot / (norm * qnorm), 9), 0) AS score FROM (SELECT DISTINCT item_id FROM benchmark) b CROSS JOIN documents d
  LEFT JOIN s USING (item_id, doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN qn USING (item_id))
SELECT item_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) AS rank FROM r QUALIFY rank <= 3""")
def tfidf_top3(spark: SparkSession, d: str) -> DataFrame:
    top = retrieve(_table(spark, d, "documents"), _table(spark, d, "benchmark"), 3, query="item_id")
    return top.select("item_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunk_text(_table(spark, d, "documents").select("doc_id", "text"))


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return extract_html(_table(spark, d, "pages").select("page_id", "html"))


@query()
def html_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunk_text(extract_html(_table(spark, d, "pages").select("page_id", F.col("url").alias("source"), "html")), 500, 50)


@query("""
WITH n AS (SELECT count(*) AS n FROM documents), o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents),
b AS (SELECT unnest(range(n)) AS batch_index, n FROM n), k AS (SELECT batch_index, unnest(range(least(3, n))) AS k, n FROM b)
SELECT batch_index, k::INT AS k, doc_id FROM k JOIN o ON o.place = (batch_index * least(3, n) + k) % n""")
def grounding_window(spark: SparkSession, d: str) -> DataFrame:
    """For every batch the chunks that it is grounded on, three at a time, going round; as many batches as chunks."""
    o = with_seq(_table(spark, d, "documents").select("doc_id"), "doc_id")
    total = o.agg(F.count("*").alias("n"))
    width = F.least(F.lit(3), F.col("n"))
    wanted = o.select(F.col("seq").alias("batch_index")).crossJoin(total).select("batch_index", "n", F.explode(F.sequence(F.lit(0).cast("long"), width - 1)).alias("k"))
    wanted = wanted.select("batch_index", F.col("k").cast("int").alias("k"), ((F.col("batch_index") * width + F.col("k")) % F.col("n")).alias("seq"))
    return wanted.join(o, "seq").select("batch_index", "k", "doc_id")


# --- conversations and layouts ---

_CONV = "SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id"


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    turns = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    m = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    return turns.select(F.col("conv_id").alias("seq"), F.get("t", F.lit(0))["text"].alias("text"), F.lit(None).cast("string").alias("label"), m.alias("messages"))


def _flat(items: Column, who: str, what: str) -> list[Column]:
    return [F.array_join(F.transform(items, lambda m: m[who]), ",").alias("roles"), F.md5(F.array_join(F.transform(items, lambda m: m[what]), "|")).alias("digest")]


@query(f"SELECT conv_id, array_to_string(roles, ',') AS roles, md5(array_to_string(texts, '|')) AS digest FROM ({_CONV})")
def conversation_assemble(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d).select(F.col("seq").alias("conv_id"), *_flat(F.col("messages"), "role", "content"))


@query(f"SELECT conv_id FROM ({_CONV}) WHERE len(roles) >= 2 AND len(list_filter(roles, lambda x, i: x <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0 AND len(list_filter(texts, lambda x: x IS NULL)) = 0")
def conversation_valid(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d).filter(alternates(F.col("messages"))).select(F.col("seq").alias("conv_id"))


@query(f"SELECT conv_id, array_to_string(roles, ',') AS roles, md5(array_to_string(texts, '|')) AS digest FROM ({_CONV})")
def to_openai(spark: SparkSession, d: str) -> DataFrame:
    return openai(_conversations(spark, d)).select(F.col("seq").alias("conv_id"), *_flat(F.col("record.messages"), "role", "content"))


@query(f"SELECT conv_id, array_to_string(list_transform(roles, lambda r: CASE r WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE r END), ',') AS roles, md5(array_to_string(texts, '|')) AS digest FROM ({_CONV})")
def to_sharegpt(spark: SparkSession, d: str) -> DataFrame:
    return sharegpt(_conversations(spark, d)).select(F.col("seq").alias("conv_id"), *_flat(F.col("record.conversations"), "from", "value"))


@query("SELECT doc_id, 'user,assistant' AS roles, md5(text || '|' || lang) AS digest FROM documents")
def to_openai_single(spark: SparkSession, d: str) -> DataFrame:
    return openai(_docs(spark, d)).select(F.col("seq").alias("doc_id"), *_flat(F.col("record.messages"), "role", "content"))


@query("SELECT doc_id, text AS instruction, '' AS input, lang AS output FROM documents")
def to_alpaca(spark: SparkSession, d: str) -> DataFrame:
    return alpaca(_docs(spark, d)).select(F.col("seq").alias("doc_id"), "record.*")


@query("SELECT doc_id, text, lang AS label FROM documents")
def to_csv(spark: SparkSession, d: str) -> DataFrame:
    return _id(csv_columns(_docs(spark, d)))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{os.urandom(8).hex()}"


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS seq, text, lang AS label FROM documents")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSONL part files and read again."""
    path = _folder(spark, "jsonl")
    write_lines(records(_docs(spark, d)), path)
    return read_jsonl(spark, path).select("seq", "text", "label")


@query("SELECT text, lang AS label FROM documents")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    write_csv(_docs(spark, d), path)
    return read_csv(spark, path).select("text", "label")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) BETWEEN 10 AND 10000")
def stream_validate(spark: SparkSession, d: str) -> DataFrame:
    """Length validation as a stream over the table's files, all that is there now."""
    source = f"{d}/documents.parquet"
    schema = spark.read.parquet(source).schema
    out, mark = _folder(spark, "stream"), _folder(spark, "stream-state")
    write_available(validated(read_stream(spark, source[:-1] + "[t]", schema)), out, mark)
    return spark.read.schema(schema).parquet(out).select("doc_id", F.length("text").alias("n"))


# --- replies: built from documents, then parsed ---


def _replies(spark: SparkSession, d: str, *columns: Column) -> DataFrame:
    """One reply per document: a JSON array of one object, bare, in a fence or after thinking tags, by doc_id."""
    body = F.to_json(F.array(F.struct(*columns)))
    wrapped = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<think>[1]\n</think> "), body, F.lit(" <|end|> more")))
    return _table(spark, d, "documents").select("doc_id", F.coalesce(wrapped, body).alias("response"))


def _parsed(spark: SparkSession, d: str, config: dict, *columns: Column) -> DataFrame:
    task = create_task(config)
    return task.valid(task.parse(_replies(spark, d, *columns))).drop("pos")


@query("SELECT doc_id, true AS ok FROM documents")
def clean_response(spark: SparkSession, d: str) -> DataFrame:
    """Whether every cleaned reply is the JSON that went in."""
    want = F.to_json(F.array(F.struct(F.col("doc_id").alias("id"))))
    r = _replies(spark, d, F.col("doc_id").alias("id"))
    return r.select("doc_id", (T.clean_response(F.col("response")) == want).alias("ok"))


_NONE_CUT = "NOT regexp_matches(text, '<\\|[^>]+\\|>') AND text <> ''"


@query(f"SELECT doc_id, text, lang AS label FROM documents WHERE lang IN ('en', 'de') AND {_NONE_CUT}")
def parse_classification(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, {"type": "classification", "labels": "en, de"}, F.col("text"), F.col("lang").alias("label"))


@query(f"SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_entities FROM documents WHERE {_NONE_CUT}")
def parse_ner(spark: SparkSession, d: str) -> DataFrame:
    """The first three characters are the entity; every other document has a wrong span."""
    e = F.struct(F.substring("text", 1, 3).alias("text"), F.lit("X").alias("label"), F.lit(0).alias("start"), F.when(F.col("doc_id") % 2 == 0, F.least(F.lit(3), F.length("text"))).otherwise(0).alias("end"))
    return _parsed(spark, d, {"type": "ner", "entity_types": ["X"]}, F.col("text"), F.array(e).alias("entities")).select("doc_id", "text", F.size("entities").alias("n_entities"))


@query(f"SELECT doc_id, text, lang AS label, source AS context FROM documents WHERE {_NONE_CUT}")
def parse_qa(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, {"type": "qa"}, F.col("text").alias("question"), F.col("lang").alias("answer"), F.col("source").alias("context")).select("doc_id", "text", "label", "context")


@query(f"SELECT doc_id, text, lang AS chosen, source AS rejected FROM documents WHERE {_NONE_CUT}")
def parse_preference(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, {"type": "preference"}, F.col("text").alias("prompt"), F.col("lang").alias("chosen"), F.col("source").alias("rejected")).select("doc_id", "text", "chosen", "rejected")


@query(f"SELECT doc_id, text AS instruction, lang AS response FROM documents WHERE {_NONE_CUT}")
def parse_sft(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, {"type": "sft"}, F.col("text").alias("instruction"), F.col("lang").alias("response")).select("doc_id", "instruction", "response")


@query(f"SELECT doc_id, text, 2 AS n FROM documents WHERE doc_id % 2 = 0 AND {_NONE_CUT}")
def parse_conversation(spark: SparkSession, d: str) -> DataFrame:
    """Every other document's conversation begins with the assistant and is dropped."""
    roles = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("user"), F.lit("assistant"))).otherwise(F.array(F.lit("assistant"), F.lit("user")))
    m = F.array(*[F.struct(F.get(roles, F.lit(i)).alias("role"), F.col(c).alias("content")) for i, c in enumerate(("text", "lang"))])
    return _parsed(spark, d, {"type": "conversation"}, m.alias("messages")).select("doc_id", "text", F.size("messages").alias("n"))


@query(f"SELECT doc_id, text, lang AS label FROM documents WHERE {_NONE_CUT}")
def parse_summarization(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d, {"type": "summarization"}, F.col("text").alias("document"), F.col("lang").alias("summary"))


@query(f"SELECT doc_id, text AS instruction, lang AS teacher_response, source AS reasoning FROM documents WHERE doc_id % 2 = 0 AND {_NONE_CUT}")
def parse_distillation(spark: SparkSession, d: str) -> DataFrame:
    """Every other document's reasoning is empty, which fails the required keys."""
    reasoning = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return _parsed(spark, d, {"type": "distillation"}, F.col("text").alias("instruction"), F.col("lang").alias("teacher_response"), reasoning.alias("reasoning")).select("doc_id", "instruction", "teacher_response", "reasoning")


@query("""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (doc_id % 5 + 1) || '.0,3.0' WHEN 1 THEN (doc_id % 5 + 1) || '.5,2.0' ELSE '3.0,3.0' END AS scores FROM documents""")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Replies of three kinds: JSON with one score of two, plain numbers, neither."""
    grade = (F.col("doc_id") % 5 + 1).cast("string")
    reply = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('[{"index": 0, "score": '), grade, F.lit("}]"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("first "), grade, F.lit(".5, then 2"))).otherwise("no idea")
    scores = parse_scores(reply, F.lit(2), 3.0)
    return _table(spark, d, "documents").select("doc_id", F.array_join(F.transform(scores, lambda x: x.cast("string")), ",").alias("scores"))


_PRICE_ROWS = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in PRICES.items())


@query(f"SELECT model, round(sum(length(text) // 4) / 1e6 * any_value(p_in) + sum(3 * (length(text) // 4)) / 1e6 * any_value(p_out), 6) AS cost FROM documents CROSS JOIN (VALUES {_PRICE_ROWS}) p(model, p_in, p_out) GROUP BY model")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """What it would cost each known model to read all documents and write three times as much."""
    used = _table(spark, d, "documents").agg(F.sum(F.expr("length(text) div 4")).alias("n"))
    prices = spark.createDataFrame([(k, *v) for k, v in PRICES.items()], "model string, p_in double, p_out double")
    return used.crossJoin(prices).select("model", F.round(F.col("n") / 1e6 * F.col("p_in") + 3 * F.col("n") / 1e6 * F.col("p_out"), 6).alias("cost"))


@query("SELECT source, CASE " + " ".join(f"WHEN count(*) < {n} THEN '{name}'" for n, name in SIZES) + " ELSE 'n>1M' END AS size FROM documents GROUP BY source")
def size_categories(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).select("source", size_category_column(F.col("n")).alias("size"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN role = 'system' THEN 'unknown' ELSE role END AS label FROM conversations) GROUP BY label")
def entity_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Entities made of turns, with the role as label; a system turn has none."""
    e = F.struct(F.when(F.col("role") != "system", F.col("role")).alias("label"))
    return metrics.entity_distribution(_table(spark, d, "conversations").select(F.array(e).alias("entities")))


# --- files, runs, cards ---


@query("SELECT text, lang AS label FROM documents")
def parquet_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "parquet")
    write_parquet(_docs(spark, d), path)
    return spark.read.parquet(path).select("text", "label")


@query("SELECT text, lang AS label FROM documents")
def huggingface_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "huggingface")
    write_huggingface(_docs(spark, d), path)
    return spark.read.parquet(f"{path}/data").select("text", "label")


@query("SELECT text, lang AS label FROM documents")
def samples_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Exported as JSONL part files and read as samples."""
    path = _folder(spark, "samples")
    export(_docs(spark, d), path, "jsonl")
    return read_samples(spark, path).select("text", "label")


def _nations(spark: SparkSession, d: str) -> DataFrame:
    """nation as samples, with the region as label: a table of 25 rows at every scale."""
    return samples_of(_table(spark, d, "nation").withColumn("region", F.col("n_regionkey").cast("string")), "n_nationkey", "n_name", "region")


@query("SELECT n_name AS text, n_regionkey::VARCHAR AS label FROM nation")
def stream_writer(spark: SparkSession, d: str) -> DataFrame:
    """Written batch by batch, one a region, and read again."""
    path, rows = f"{_folder(spark, 'streamed')}.jsonl", _nations(spark, d)
    with StreamingWriter(path) as w:
        for r in rows.select("label").distinct().orderBy("label").collect():  # five regions
            w.write_batch(rows.filter(F.col("label") == r["label"]))
    return read_jsonl(spark, path).select("text", "label")


@query("SELECT n_nationkey AS key, n_name AS text, 0 AS chunk_index, 1 AS total_chunks FROM nation")
def load_text_files(spark: SparkSession, d: str) -> DataFrame:
    """A file for each nation, loaded as documents."""
    folder = _folder(spark, "files")
    for r in _nations(spark, d).collect():
        with Output(spark, f"{folder}/{r['seq']}.txt") as f:
            f.write(f"  {r['text']}\n")
    key = F.regexp_extract("source", r"(\d+)\.txt$", 1).cast("int")
    return load_documents(spark, folder).select(key.alias("key"), "text", "chunk_index", "total_chunks")


def _cycle(items: tuple[str, ...], key: str = "n_nationkey") -> str:
    """SQL for the item whose turn it is."""
    return f"CASE {key} % {len(items)} " + " ".join(f"WHEN {i} THEN '{x.replace(chr(39), chr(39) * 2)}'" for i, x in enumerate(items)) + " END"


_LF = "chr(10) || chr(10) || "
_VARY = f"CASE WHEN n_nationkey = 0 THEN '' ELSE {_LF}'Batch ' || (n_nationkey + 1) || ': choose subjects, words and forms that no batch before has used.' END"


@query(f"""
SELECT 'direct' AS strategy, n_nationkey AS batch_index, n_name || {_VARY} AS content FROM nation
UNION ALL SELECT 'few_shot', n_nationkey, n_name || {_LF}'Aim for the quality of these examples, with other content:' || chr(10) || '- one' || chr(10) || '- two' || chr(10) || '- three' || {_VARY} FROM nation
UNION ALL SELECT 'persona', n_nationkey, n_name || {_LF}'Write as ' || {_cycle(PERSONAS)} || ' would: their words, interests and point of view.' FROM nation
UNION ALL SELECT 'cot', n_nationkey, n_name || {_LF}'{DEPTHS["brief"]}' || {_VARY} FROM nation
UNION ALL SELECT 'adversarial', n_nationkey, n_name || {_LF}'Make the elements hard for a model by means of ' || {_cycle(MODES)} || '. They must still be correct.' FROM nation
UNION ALL SELECT 'evolinstruct', n_nationkey, n_name || {_LF}'Start from a plain element and make it harder:' || chr(10) || '- ' || {_cycle(EVOLUTIONS)} || chr(10) || '- ' || {_cycle(EVOLUTIONS, "(n_nationkey + 1)")} FROM nation""")
def strategy_prompts(spark: SparkSession, d: str) -> DataFrame:
    """What every strategy makes of a message for 25 batches."""
    options = {"few_shot": {"examples": ["one", "two", "three", "four"]}, "cot": {"reasoning_depth": "brief"}, "evolinstruct": {"evolution_rounds": 2}}
    rows = []
    for name in ("direct", "few_shot", "persona", "cot", "adversarial", "evolinstruct"):
        strategy = create_strategy(name, options.get(name, {}))
        rows += [(name, r["seq"], strategy.apply([{"role": "user", "content": r["text"]}], r["seq"])[-1]["content"]) for r in _nations(spark, d).collect()]
    return spark.createDataFrame(rows, "strategy string, batch_index int, content string")


_RUN = {"type": "classification", "labels": "en, de", "provider": {"model": "gpt-4o"}}


@query(f"""
WITH r AS (SELECT r_regionkey AS k, 100 * r_regionkey + 7 AS num_samples FROM region), b AS (SELECT *, ceil(ceil(round(num_samples * 1.2, 6)) / 8)::INT AS num_batches FROM r),
t AS (SELECT *, {sum(len(m["content"]) for m in create_task(_RUN).build_messages(8)) // 4} * num_batches AS n FROM b)
SELECT num_samples, num_batches, n AS tokens_in, 3 * n AS tokens_out, round((n * {PRICES["gpt-4o"][0]} + 3 * n * {PRICES["gpt-4o"][1]}) / 1e6, 6) AS cost FROM t""")
def run_estimates(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for r in _table(spark, d, "region").collect():  # five
        n = 100 * r["r_regionkey"] + 7
        e = estimate_run(_RUN | {"generation": {"num_samples": n, "batch_size": 8}})
        rows.append((n, e["num_batches"], e["estimated_input_tokens"], e["estimated_output_tokens"], round(e["estimated_cost_usd"], 6)))
    return spark.createDataFrame(rows, "num_samples int, num_batches int, tokens_in int, tokens_out int, cost double")


@query("SELECT * FROM (VALUES " + ", ".join(f"('vendor/{k}-latest', {a}::DOUBLE)" for k, (a, _) in PRICES.items()) + ", ('nothing known', 0::DOUBLE)) t(model, cost)")
def price_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A million tokens read by models whose names hold a known name: the longest such name counts."""
    known = spark.createDataFrame([(k, a, len(k)) for k, (a, _) in PRICES.items()], "name string, price double, size int")
    models = spark.createDataFrame([(f"vendor/{k}-latest",) for k in PRICES] + [("nothing known",)], "model string")
    return models.join(F.broadcast(known), F.contains("model", F.col("name")), "left").groupBy("model").agg(F.coalesce(F.max_by("price", "size"), F.lit(0.0)).alias("cost"))


@query(f"""
WITH u AS (SELECT doc_id, text, lang FROM {S.unique_documents()} WHERE length(text) BETWEEN 10 AND 10000 AND lang IN ('en', 'de', ''))
SELECT doc_id, lang AS label FROM u QUALIFY row_number() OVER (ORDER BY doc_id) <= 200""")
def curated_run(spark: SparkSession, d: str) -> DataFrame:
    """The curation of a run: exact dedup, lengths, allowed labels of the task, trim to the samples wanted (the feature)."""
    config = _RUN | {"generation": {"num_samples": 200}, "quality": {"similarity_threshold": 1.0}}
    return _id(curate(_docs(spark, d), config, create_task(config))).select("doc_id", "label")


@query(f"SELECT doc_id * 1048576 AS seq, text, lang AS label FROM documents WHERE lang IN ('en', 'de') AND {_NONE_CUT}")
def checkpoint_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies saved as a run's checkpoint, in two waves, then loaded and parsed."""
    r = _replies(spark, d, F.col("text"), F.col("lang").alias("label")).select(F.col("doc_id").cast("int").alias("batch_index"), F.col("response").alias("content"))
    r = r.withColumns({"input_tokens": F.lit(1).cast("long"), "output_tokens": F.lit(2).cast("long"), "attempts": F.lit(1)})
    c = Checkpoint(spark, _RUN, _folder(spark, "checkpoint"))
    for wave in (0, 1):
        c.save(r.filter(F.col("batch_index") % 2 == wave))
    return parse_replies(c.load(), create_task(_RUN)).select("seq", "text", "label")


@query("SELECT '| ' || lang || ' | ' || format('{:,}', count(*)) || ' | ' || printf('%.1f', 100.0 * count(*) / sum(count(*)) OVER ()) || '% |' AS line FROM documents GROUP BY lang")
def card_labels(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a dataset card's label table."""
    card = generate_card(_docs(spark, d), "own/documents", _RUN)
    table = card.split("## Labels")[1].split("## Examples")[0]
    return spark.createDataFrame([(x,) for x in table.split("\n") if x.endswith("% |")], "line string")


@query(f"SELECT 'distinct_' || n AS metric, ratio AS value FROM ({ORACLES['distinct_n']}) UNION ALL SELECT 'vocabulary_size', vocabulary_size FROM ({ORACLES['vocabulary']}) UNION ALL SELECT 'total_tokens', total_tokens FROM ({ORACLES['vocabulary']})")
def diversity_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = metrics.DiversityReporter().process(_docs(spark, d))
    return spark.createDataFrame([(k, float(v)) for k, v in report.details.items()], "metric string, value double")
