"""The shared folder: results written once and read again, which cuts lineage and survives lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


#: Inputs of fewer bytes (as the plan estimates) are dealt out by spread().
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if it is small or in fewer row groups than cores: a row group is read and worked on by one task alone.

    For operators that spend much more on a row than it costs to move it. Inputs in many row groups stay as they are.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size < SMALL:
        return df.repartition(cores)
    if _row_groups(df, 2 * cores) < 2 * cores:
        return df.repartition(max(2 * cores, min(size // (SMALL // 2), 100 * cores)))
    return df


def _row_groups(df: DataFrame, enough: int) -> int:
    """Row groups of the Parquet files that df reads, counted up to enough; enough where df reads anything else."""
    files = df.inputFiles()
    if not files or len(files) >= enough or not all(f.endswith(".parquet") for f in files):
        return enough
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for f in files:  # fewer than enough
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        n += reader.getRowGroups().size()
        reader.close()
    return n


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new one is set only where the session has none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='sievecraft-')}")
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system and path; a relative path on a local one belongs to Python's working directory, which Java doesn't follow."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if "://" not in path and not path.startswith("file:") and jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf).getScheme() == "file":
        path = os.path.abspath(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on any file system that Spark knows; one that isn't there is fine."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, p = _file_system(spark, path)
    stream = fs.create(p, True)
    stream.write(data, 0, len(data))
    stream.close()


class Output:
    """A text file on any file system that Spark knows, written in pieces of a megabyte."""

    def __init__(self, spark: SparkSession, path: str):
        fs, p = _file_system(spark, path)
        fs.delete(p, True)
        fs.setWriteChecksum(False)
        self.stream, self.parts, self.size = fs.create(p, True), [], 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)
        if self.size > 1 << 20:
            self._flush()

    def writelines(self, lines: Iterable[str]) -> None:
        for x in lines:
            self.write(x)

    def _flush(self) -> None:
        data = "".join(self.parts).encode("utf-8", "surrogatepass")
        self.stream.write(data, 0, len(data))
        self.parts, self.size = [], 0

    def __enter__(self) -> Output:
        return self

    def __exit__(self, *_: object) -> None:
        self._flush()
        self.stream.close()


def materialize(df: DataFrame, what: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
