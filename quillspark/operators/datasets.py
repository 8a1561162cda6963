"""Datasets of labelled texts: folders, manifests, unions, numbered names, caches, examples by task, exports."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.files import decoded
from .training import chat_rows, split_of


def class_folders(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(split, label, file, text) of <split>/<label>/*.txt, texts without content left out; most: that many a label, chosen by a hash of the path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(folder)
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("label"), F.element_at(parts, -1).alias("file"), strip(decoded(F.col("content"))).alias("text")).where("text != ''")
    if most is None:
        return rows
    chosen = Window.partitionBy("split", "label").orderBy(F.md5("file"), "file")
    return rows.withColumn("_n", F.row_number().over(chosen)).where(F.col("_n") <= most).drop("_n")


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header line; columns are taken in the order of the schema."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False, multiLine=True, escape='"')


def manifest_audit(listed: DataFrame, files: DataFrame, rows: int | None = None, classes: dict[str, int] | None = None, label: str = "label") -> DataFrame:
    """(problem, name, expected, found) of a manifest (name, sha256, label) against files (name, sha256): digests, missing files, counts."""
    met = listed.select("name", F.col("sha256").alias("expected")).join(files.select("name", F.col("sha256").alias("found")), "name", "left")
    digests = met.where(~F.col("found").eqNullSafe(F.col("expected"))).select(F.when(F.col("found").isNull(), F.lit("missing file")).otherwise(F.lit("digest differs")).alias("problem"), "name", "expected", "found")
    parts = [digests]
    if rows is not None:
        parts.append(listed.agg(F.count("*").alias("n")).where(F.col("n") != rows).select(F.lit("row count").alias("problem"), F.lit(None).cast("string").alias("name"), F.lit(str(rows)).alias("expected"), F.col("n").cast("string").alias("found")))
    if classes:
        have = listed.groupBy(F.col(label).alias("name")).agg(F.count("*").alias("n"))
        want = F.element_at(F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))]), F.col("name"))
        parts.append(have.where(~want.eqNullSafe(F.col("n"))).select(F.lit("class count").alias("problem"), "name", want.cast("string").alias("expected"), F.col("n").cast("string").alias("found")))
    return reduce(DataFrame.union, parts)


def united(sources: dict[str, DataFrame], splits: dict[str, str] | None = None) -> DataFrame:
    """Sources by label, each (split, name, text), as one dataset; splits renames them (test as val, say), all others stay."""
    renamed = F.coalesce(F.element_at(F.create_map(*[x for k, v in splits.items() for x in (F.lit(k), F.lit(v))]), F.col("split")), F.col("split")) if splits else F.col("split")
    return reduce(DataFrame.unionByName, [df.select(renamed.alias("split"), F.lit(label).alias("label"), "name", "text") for label, df in sources.items()])


def numbered(examples: DataFrame, prefixes: dict[str, str] | None = None) -> DataFrame:
    """(split, label, file, text): names {prefix}_{0001}.txt by split and label, in the order of two digits of the old names' md5 and then the names; blank texts get none.

    Numbers come from counts of ranges and a window inside each, so a split of any size is numbered in many tasks.
    """
    kept = examples.where(strip(F.coalesce("text", F.lit(""))) != "")
    cell = F.substring(F.md5("name"), 1, 2)
    placed = kept.withColumn("_cell", cell)
    counts = placed.groupBy("split", "label", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("split", "label").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("split", "label", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("split", "label", "_cell").orderBy("name")
    number = F.col("_before") + F.row_number().over(inside)
    named = F.element_at(F.create_map(*[x for k, v in prefixes.items() for x in (F.lit(k), F.lit(v))]), F.col("label")) if prefixes else F.col("label")
    return placed.join(offsets, ["split", "label", "_cell"]).select("split", "label", F.format_string("%s_%04d.txt", F.coalesce(named, F.col("label")), number).alias("file"), "name", "text")


def write_labelled(examples: DataFrame, folder: str) -> None:
    examples.write.mode("overwrite").partitionBy("split", "label").parquet(folder)


def cache_plan(selected: DataFrame, cached: DataFrame | None, key: str = "name", overwrite: bool = False) -> DataFrame:
    """selected with what to do: 'skipped' where the cache has the key already (unless overwrite), else 'process'."""
    if cached is None or overwrite:
        return selected.withColumn("action", F.lit("process"))
    have = cached.select(key).distinct().withColumn("_have", F.lit(True))
    return selected.join(have, key, "left").withColumn("action", F.when(F.col("_have"), F.lit("skipped")).otherwise(F.lit("process"))).drop("_have")


def cache_outcome(planned: DataFrame, text: str = "text") -> DataFrame:
    """One row: selected, processed, skipped, failed (no text came out), empty."""
    todo = F.col("action") == "process"
    blank = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    return planned.agg(F.count("*").alias("selected"), F.count_if(todo & ~blank).alias("processed"), F.count_if(~todo).alias("skipped"), F.count_if(todo & F.col(text).isNull()).alias("failed"), F.count_if(todo & F.col(text).isNotNull() & blank).alias("empty"))


def tasks(chunks: DataFrame, kinds: tuple[str, ...], body) -> DataFrame:
    """An example for each chunk and kind of task: (doc_id, chunk_index, task, output, error).

    body(kind, content) gives a column; where it is null the example has an error and the others go on.
    """
    each = [F.struct(F.lit(k).alias("task"), body(k, F.col("content")).cast("string").alias("output")) for k in kinds]
    rows = chunks.select("doc_id", "chunk_index", F.explode(F.array(*each)).alias("t")).select("doc_id", "chunk_index", "t.*")
    return rows.withColumn("error", F.when(F.col("output").isNull(), F.lit("task gave no output")))


def job_account(examples: DataFrame, documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row: documents in all, those with an example, those without any that worked, and the job's status."""
    worked = examples.where("error is null").select(doc_id).distinct().withColumn("_ok", F.lit(True))
    rows = documents.select(doc_id).distinct().join(worked, doc_id, "left")
    counted = rows.agg(F.count("*").alias("total"), F.count_if(F.col("_ok")).alias("processed"), F.count_if(F.col("_ok").isNull()).alias("failed"))
    return counted.select("*", F.when(F.col("total") == F.col("processed"), F.lit("completed")).when(F.col("processed") == 0, F.lit("failed")).otherwise(F.lit("partial")).alias("status"))


def marked_approved(examples: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """examples with approved: whether their document has quality 1 (documents without a label are not)."""
    good = labels.groupBy(doc_id).agg(F.max((F.col("quality") == 1).cast("int")).alias("_q"))
    return examples.join(good, doc_id, "left").withColumn("approved", F.coalesce(F.col("_q") == 1, F.lit(False))).drop("_q")


def export(examples: DataFrame, folder: str, kind: str = "jsonl", key: str | None = None, prompt: str = "prompt", answer: str = "answer") -> None:
    """Writes examples as jsonl, csv, parquet, huggingface (parquet in data/<split>) or openai conversations; key: split by its hash."""
    rows = examples.withColumn("split", split_of(F.col(key))) if key else examples
    if kind not in ("jsonl", "csv", "parquet", "huggingface", "openai"):
        raise ValueError(f"unknown format {kind}")
    if kind == "openai":
        rows = chat_rows(rows, prompt, answer, ["split"] if key else [])
    out = rows.write.mode("overwrite")
    out = out.partitionBy("split") if key else out
    if kind == "jsonl":
        out.json(folder)
    elif kind == "csv":
        out.option("header", True).option("escape", '"').csv(folder)
    elif kind == "openai":
        out.text(folder)
    else:
        out.parquet(f"{folder}/data" if kind == "huggingface" else folder)


def query_label(number: Column) -> Column:
    """Q01, Q02, ..."""
    return F.concat(F.lit("Q"), F.lpad(number.cast("string"), 2, "0"))
