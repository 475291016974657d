"""TF-IDF retrieval of the most similar documents for each query, as sparse joins on terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, spread

_WORD = re.compile(r"\w+")


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf: counted within each row, so that nothing is shuffled."""
    slim = spread(docs.select(F.col(key), F.col(text).alias("text")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row, terms, tf = [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    counts = Counter(_WORD.findall(t.lower())) if t else {}
                    row += [i] * len(counts)
                    terms += counts.keys()
                    tf += counts.values()
                yield pa.record_batch([part.column(key).take(pa.array(row, pa.int64())), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], names=[key, "term", "tf"])

    return slim.mapInArrow(run, slim.select(key).schema.add("term", "string").add("tf", "long"))


def retrieve(docs: DataFrame, queries: DataFrame, k: int = 3, doc: str = "doc_id", query: str = "query_id", text: str = "text") -> DataFrame:
    """query, doc, score, rank of the k best documents for each query by cosine of tf * ln(N / df). Keys must be unique.

    Terms in all documents carry no weight. Ties go to the higher document key, and documents without a common
    term fill up to k with score 0: only the k highest keys can be among those. Query terms are joined with
    document terms; nothing is compared that shares no term. Texts are split once, and each join reads what it needs.
    """
    tf = materialize(term_counts(docs, doc, text), "term-counts")
    total = docs.agg(F.count("*").alias("total"))
    idf = materialize(tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(total).filter("df < total").select("term", F.ln(F.col("total") / F.col("df")).alias("idf")), "idf")
    weight = F.col("tf") * F.col("idf")
    norms = tf.join(idf, "term").groupBy(doc).agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    asked = term_counts(queries, query, text).join(idf, "term").select(query, "term", "idf", (F.col("tf") * F.col("idf")).alias("q"))
    asked = materialize(asked, "asked-terms")
    asked_norm = asked.groupBy(query).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("q_norm"))
    # asked terms carry their idf: only the postings of these terms are joined
    dots = tf.join(asked, "term").groupBy(query, doc).agg(F.sum(F.col("q") * weight).alias("dot"))
    scored = dots.join(norms, doc).join(asked_norm, query).select(query, doc, F.round(F.col("dot") / (F.col("norm") * F.col("q_norm")), 9).alias("score"))
    best = Window.partitionBy(query).orderBy(F.desc("score"), F.desc(doc))
    # the k highest keys may fill up with score 0; k rows for each query are kept, and those of these keys
    highest = [r[0] for r in docs.select(doc).filter(F.col(doc).isNotNull()).distinct().orderBy(F.desc(doc)).limit(k).collect()]
    ranked = materialize(scored.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) | F.col(doc).isin(highest)), "ranked")
    fill = queries.select(query).distinct().crossJoin(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in highest], docs.select(doc).schema)))
    # a document that is scored can't come back with 0: real scores are positive
    fill = fill.join(ranked.select(query, doc), [query, doc], "left_anti").withColumn("score", F.lit(0.0))
    both = ranked.filter(F.col("rank") <= k).drop("rank").unionByName(fill)
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
