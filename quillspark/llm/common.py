"""Helpers that the operators share: storage that all executors see, small let-bindings, character classes."""

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in quality, near-duplicate and shingle operators.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where that is unset, a folder of our own in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        at = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one call writes and needs no longer than its own work: what is not kept goes when the block ends without an error."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def __enter__(self) -> "Scratch":
        return self

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            del self.paths[path]
            remove(self.spark, path)

    def keep(self, *tables: DataFrame) -> None:
        self.paths = {p: t for p, t in self.paths.items() if not any(t is x for x in tables)}

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.drop(*self.paths.values())


def remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def trimmed(run):
    """run(batches) for mapInArrow, giving the worker's free memory back at the end: workers outlive the stages that they served."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    return whole


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str, *more: str) -> str:
    """A column name that neither df nor more have yet (names clash without regard to case)."""
    have = {c.lower() for c in (*df.columns, *more)}
    while name.lower() in have:
        name = "_" + name
    return name


def free_prefix(df: DataFrame, name: str) -> str:
    """A prefix that no column of df begins with."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Renames a path of any file system that Spark reaches; fails if the new one is there."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    source, target = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = source.getFileSystem(jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target):
        raise OSError(f"can't rename {old} to {new}")


def commit_files(files: DataFrame, name: str, content: str) -> str:
    """Writes rows of file images under a temporary name, then their manifest (all columns but the content), then gives both the final name.

    Readers take the files that the manifest lists, so they see all of a write or nothing of it.
    """
    spark, path = files.sparkSession, new_path(files.sparkSession, name)
    files.write.parquet(f"{path}.tmp/files")
    spark.read.schema(files.schema).parquet(f"{path}.tmp/files").drop(content).coalesce(1).write.parquet(f"{path}.tmp/manifest")
    rename(spark, f"{path}.tmp", path)
    return path
