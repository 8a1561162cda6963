"""Tables kept in an order: dealt into cells by ranges of it, with a directory of rows a cell.

Numbers and pages of all rows need no total sort and no window over everything: a row's number is its place in its cell and the
rows of the cells before, and a page reads the cells that it lies in.

Defined cases: nulls stand where the order puts them; rows that are equal in the order follow by a hash of the row, so they are
dealt into several cells, too, and rows that are equal in all columns are alike; an empty table has no rows and one empty page.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path

#: Rows of a cell, about.
CELL_ROWS = 100_000


@dataclass(frozen=True)
class Ordered:
    """A table in the folder, by cell; order: sort expressions; rows in all."""

    spark: SparkSession
    folder: str
    order: tuple[Column, ...]
    columns: tuple[str, ...]
    schema: T.StructType
    rows: int

    def cells(self) -> DataFrame:
        """(_cell, _n, _before): rows of each cell and of those before it; as many rows as there are cells."""
        return self.spark.read.parquet(f"{self.folder}/directory")

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/rows")


def in_order(rows: DataFrame, *order: Column, folder: str | None = None, cell_rows: int = CELL_ROWS) -> Ordered:
    """Writes the rows by ranges of the order, then the directory, without which there is no table for readers."""
    spark, folder = rows.sparkSession, folder or shared_path(rows.sparkSession, "in-order")
    n = rows.count()
    parts = max(1, -(-n // cell_rows))
    by = (*order, F.col("_tie"))
    dealt = rows.withColumn("_tie", F.xxhash64(*rows.columns)).repartitionByRange(parts, *by).withColumn("_cell", F.spark_partition_id())
    dealt.write.partitionBy("_cell").parquet(f"{folder}/rows")
    held = spark.read.schema(dealt.schema).parquet(f"{folder}/rows")
    counts = held.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.select("_cell", "_n", before.alias("_before")).coalesce(1).write.parquet(f"{folder}/directory")
    return Ordered(spark, folder, by, tuple(rows.columns), dealt.schema, n)


def numbered_rows(kept: Ordered, into: str = "row") -> DataFrame:
    """All rows with their numbers, from 1."""
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(*kept.order))
    found = kept.table().join(F.broadcast(kept.cells()), "_cell").withColumn("_place", place)
    return found.select(*kept.columns, (F.col("_before") + F.col("_place")).alias(into))


def page_of(kept: Ordered, number: int, size: int) -> DataFrame:
    """Rows of a page (from 1); numbers below the first or beyond the last page give that page."""
    if size < 1:
        raise ValueError("size must be positive")
    last = max(1, -(-kept.rows // size))
    start = (min(max(1, number), last) - 1) * size
    cells = kept.cells().where((F.col("_before") < start + size) & (F.col("_before") + F.col("_n") > start)).orderBy("_cell").collect()  # those that the page lies in
    if not cells:
        return kept.table().select(*kept.columns).limit(0)
    return kept.table().where(F.col("_cell").isin([c._cell for c in cells])).orderBy(*kept.order).offset(start - cells[0]._before).limit(size).select(*kept.columns)
