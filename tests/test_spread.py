import pyarrow as pa
import pyarrow.parquet as pq

from sievecraft import storage
from sievecraft.operators.metrics import _packed, distinct_ngrams
from sievecraft.sources.samples import samples_of


def test_large_row_groups_are_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    """One row group of a large file would be one task's work."""
    monkeypatch.setattr(storage, "SMALL", 1000)
    table = pa.table({"doc_id": range(5000), "text": [f"a text b {i} c" for i in range(5000)]})
    pq.write_table(table, tmp_path / "one row.parquet")
    pq.write_table(table, tmp_path / "many.parquet", row_group_size=100)
    one, many = (spark.read.parquet(str(tmp_path / f"{x}.parquet")) for x in ("one row", "many"))
    assert storage.spread(one).rdd.getNumPartitions() >= 8 and storage.spread(one).count() == 5000
    assert storage.spread(many).rdd.getNumPartitions() == many.rdd.getNumPartitions()
    rows = {r["n"]: (r["total"], r["distinct"]) for r in distinct_ngrams(samples_of(one, "doc_id", "text")).collect()}
    grams = [w for i in range(5000) for w in f"a text b {i} c".split()]
    assert rows == {n: (len(grams) - n + 1, len({tuple(grams[i : i + n]) for i in range(len(grams) - n + 1)})) for n in (1, 2, 3)}
    assert not list(_packed(iter([]), 3))
