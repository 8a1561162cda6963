"""The stored tables: guarded appends, ownership, listings."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extract import FIELDS


def new_documents(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row for each (user_id, file_hash) that is not stored; of several the one with the smallest id."""
    order = Window.partitionBy("user_id", "file_hash").orderBy("doc_id")
    first = batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first if stored is None else first.join(stored.select("user_id", "file_hash"), ["user_id", "file_hash"], "left_anti")


def owned(docs: DataFrame, user_id: int) -> DataFrame:
    return docs.where(F.col("user_id") == user_id)


def named_like(docs: DataFrame, fragment: str | None) -> DataFrame:
    """Documents whose filename holds the fragment, literally and in any case; a blank fragment keeps all."""
    return docs if not (fragment or "").strip() else docs.where(F.lower("filename").contains(fragment.strip().lower()))


def page(docs: DataFrame, number: int, size: int) -> DataFrame:
    """A page (from 1) of the newest documents; numbers beyond the last page give the last."""
    if size < 1:
        raise ValueError("size must be positive")
    last = max(1, -(-docs.count() // size))
    return docs.orderBy(F.col("created_at").desc(), F.col("doc_id").desc()).offset((min(max(1, number), last) - 1) * size).limit(size)


def recent(docs: DataFrame, n: int = 5) -> DataFrame:
    """The newest n documents of each user."""
    order = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("doc_id").desc())
    return docs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def tables(processed: DataFrame) -> dict[str, DataFrame]:
    """Processed documents (user_id, doc_id, file_hash, text, ...) as the four stored tables."""
    v, c = F.col("validation"), F.col("classification")
    return {
        "documents": processed.select("doc_id", "user_id", "file_hash", c["label"].alias("document_type"), v["pipeline_status"].alias("processing_status"), "text", F.substring(F.regexp_replace("text", r"\s+", " "), 1, 1000).alias("text_preview"), F.to_json(F.struct("classification", "fields", "validation")).alias("result_json")),
        "classifications": processed.select("doc_id", c["label"].alias("label"), c["confidence"].alias("confidence"), c["confidence_source"].alias("confidence_source")),
        "extracted_fields": processed.select("doc_id", *[F.col(f"fields.{f}").alias(f) for f in FIELDS]).unpivot(["doc_id"], list(FIELDS), "field_name", "field_value"),
        "validation_results": processed.select("doc_id", v["pipeline_status"].alias("pipeline_status"), v["validation_score"].alias("validation_score"), v["total_warnings"].alias("warning_count"), v["critical_warning_count"].alias("critical_warning_count"), F.to_json(v["warnings"]).alias("warnings_json")),
    }


def save(processed: DataFrame, folder: str) -> None:
    """Appends the four tables."""
    for name, rows in tables(processed).items():
        rows.write.mode("append").parquet(f"{folder}/{name}")


def whole_documents(documents: DataFrame, classifications: DataFrame, extracted: DataFrame, validations: DataFrame) -> DataFrame:
    """Stored documents with their classification, fields (a column each) and validation; what is not stored is null."""
    wide = extracted.groupBy("doc_id").pivot("field_name", list(FIELDS)).agg(F.first("field_value"))
    return documents.join(classifications, "doc_id", "left").join(wide, "doc_id", "left").join(validations, "doc_id", "left")


# How types and states are shown.
TYPE_LABELS = {"invoice": "Invoice", "receipt": "Receipt", "purchase_order": "Purchase Order"}
STATUS_LABELS = {"processed": "Processed", "processed_with_warnings": "Processed with warnings", "needs_review": "Needs review"}


def _shown(value, labels: dict[str, str], otherwise):
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]), value), otherwise)


def history_rows(records: DataFrame) -> DataFrame:
    """(filename, type, processed, status, supplier, date, amount) of stored records (filename, created_at, document_type, result_json).

    Results that are no JSON object count as empty: the type is then the record's own, the status processed.
    """
    field = lambda path: F.get_json_object("result_json", path)
    kind = F.coalesce(field("$.classification.label"), F.col("document_type"))
    status = F.coalesce(field("$.validation.pipeline_status"), F.lit("processed"))
    return records.select(
        "filename", _shown(kind, TYPE_LABELS, F.coalesce(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit("Unknown"))).alias("type"), F.col("created_at").alias("processed"), _shown(status, STATUS_LABELS, status).alias("status"),
        *[field(f"$.fields.{f}").alias(f) for f in ("supplier", "date", "amount")],
    )


def with_defaults(records: DataFrame) -> DataFrame:
    """records with text from raw_text, type from document_type and id from document_id where they are missing or empty."""
    given = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(other).cast("string"))
    return records.withColumns({"text": given("text", "raw_text"), "type": given("type", "document_type"), "id": F.coalesce(F.col("id"), F.col("document_id").cast("string"))})


def size_shown(size):
    """Bytes as B, KB or MB."""
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1 << 20, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", size / (1 << 20)))


def as_whole(text):
    """A whole number, else null."""
    return F.trim(text).try_cast("long")


def as_number(text):
    """A number, else null."""
    return F.trim(text).try_cast("double")


def user_corpus(documents: DataFrame, user_id: int) -> DataFrame:
    """The rows that a user's search is built from, oldest first (doc_ord from 1), blank texts left out.

    A user's documents are numbered by time and id in one window: the corpus of one user, not of all.
    """
    mine = documents.where((F.col("user_id") == user_id) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return mine.withColumn("doc_ord", F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "doc_id")))


def save_vectors(vectors: DataFrame, folder: str, dimension: int, vector: str = "embedding") -> None:
    """Writes vectors for searches; fails if any has another dimension."""
    checked = F.when(F.size(vector) == dimension, F.col(vector)).otherwise(F.raise_error(F.concat(F.lit(f"dimension is not {dimension}: "), F.size(vector).cast("string"))))
    vectors.withColumn(vector, checked).write.mode("append").parquet(folder)
