"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, BPE.

Defined cases: null, empty and blank texts fail the quality rules and go; of repeated rows and equal texts one stays, that with
the smallest id (null ids last); very long texts pass through every stage whole; empty tables give no rows. Extra columns stay
under whatever names, but for n_chars, which is counted anew where texts change, and for columns that carry the name of what the
last stage adds (ids, n_tokens), which are replaced.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import bpe_code
from quillspark.llm.common import new_path, table
from quillspark.llm.decontam import decontaminate
from quillspark.llm.ngramjoin import keep_one
from quillspark.llm.pii import redact
from quillspark.llm.quality import quality

#: SQL can't express BPE merges, nor the trained span classifier.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text is now."""
    return docs.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that all rules hold for."""
    return quality(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that stand in the benchmark."""
    return _counted(decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="spans"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _counted(redact(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their text and the text decoded from these."""
    kept = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "n_tokens")])
    coded = bpe_code(kept, into="text")
    return coded.select(*kept.columns, (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
