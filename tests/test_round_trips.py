import json

from pyspark.sql import functions as F

from sievecraft.sinks import write_csv
from sievecraft.sources.samples import read_csv, read_jsonl, samples_of


def test_jsonl_order_of_files(spark, tmp_path):
    """The second file is the larger one, which Spark reads first."""
    small, large = [f"s{i}" for i in range(3)], [f"l{i}" * 2000 for i in range(500)]
    for name, texts in (("part-0", small), ("part-1", large)):
        (tmp_path / name).write_text("\n\n".join(json.dumps({"text": t}) for t in texts))
    conf = {"spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    rows = read_jsonl(spark, str(tmp_path)).orderBy("seq").collect()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert [r["text"] for r in rows] == small + large and [r["seq"] for r in rows] == list(range(503))


def test_csv_cells_stay_as_they_are(spark, tmp_path):
    texts = ["a\n", " a", "a ", "\ta", "", " ", "\n", '"', 'a "b"', 'a\0"\0b', "a,b\nc", "\\", "é\u0085"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, t string").withColumn("l", F.lit("x "))
    for label in ("l", None):
        path = str(tmp_path / f"csv-{label}")
        write_csv(samples_of(docs, "i", "t", label), path)
        rows = read_csv(spark, path).orderBy("seq").collect()
        assert [r["text"] for r in rows] == texts and {r["label"] for r in rows} == {"x " if label else None}
