"""A stored index of vectors in inverted lists, searched by inner product.

Centres are fitted by k-means on a sample of bounded size; every vector goes to the list of its nearest centre. The index is a
table of vectors partitioned by list and a small table of lists (at most MAX_LISTS rows: centre, radius, rows, cells). Lists are
dealt into cells of about CELL_ROWS vectors, and the queries that probe a list into blocks of as many, so that a list which holds
a third of all vectors, or which most queries probe, is shared by many tasks. A cell and a block meet in one matrix product that
hands on k rows a query.

A query probes the lists whose centres have the largest inner product with it. How many are needed for a wished recall is
measured (``probes_for``) on a sample of queries against all vectors. No vector of a list has a larger product than
q.c + |q| * radius, so ``exact=True`` goes on to the lists that could still hold one of the k best, and to no others.

Defined cases: vectors that are null are left out of the index, and queries without a vector get no rows; a vector of another
dimension is an error; equal scores (rounded to six digits) go by the smaller id; an empty table gives an empty index.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centres are fitted on, about; lists at most; vectors of a cell and queries of a block, about.
SAMPLE, MAX_LISTS, CELL_ROWS = 100_000, 4096, 8192
#: Rows (a query and a list) that a task hands on at a time, about.
PROBE_ROWS = 1 << 14
#: Queries that the number of probes is measured on, about.
SAMPLE_QUERIES = 200
#: A score is rounded, so a bound counts as reached from here on.
_HALF_STEP = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """Where an index lies, and its lists: numbers, centres (a row each), radii and cells."""

    spark: SparkSession
    folder: str
    numbers: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    cells: np.ndarray

    def vectors(self) -> DataFrame:
        """(vec_id, vector, list, cell) of all vectors."""
        return self.spark.read.schema("vec_id long, vector array<double>, cell int, list int").parquet(f"{self.folder}/vectors")


def _hashed_share(column: str, share: float):
    """Holds for about a share of the rows, by a hash of a column: the same rows in every run."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(17)), F.lit(1 << 30)) < F.lit(int(np.ceil(min(1.0, share) * (1 << 30))))


def build_index(vectors: DataFrame, folder: str, dimension: int, vec_id: str = "vec_id", vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
    """Fits centres, writes all vectors by list, then the table of lists, without which there is no index for readers."""
    spark = vectors.sparkSession
    checked = F.when(F.size(vector) == dimension, F.col(vector).cast("array<double>")).otherwise(F.raise_error(F.concat(F.lit(f"dimension is not {dimension}: "), F.size(vector).cast("string"))))
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), checked.alias("vector"))
    n = rows.count()
    kind = "list int, centre array<double>, rows long, radius double, cells int"
    if n:
        featured = rows.withColumn("features", array_to_vector("vector"))
        some = featured.where(_hashed_share("vec_id", sample / n)).limit(2 * sample).select("features")
        # Spark's k-means takes two centres at least, and gives fewer where the sample has fewer different vectors.
        wished = max(2, min(lists or round(n**0.5), MAX_LISTS))
        model = KMeans(k=wished, seed=seed, maxIter=10, initMode="random").fit(featured.limit(wished).select("features") if some.isEmpty() else some)
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "list int, centre array<double>")
        model.setPredictionCol("list")
        dealt = model.transform(featured).drop("features")
        away = F.sqrt(F.aggregate(F.zip_with("vector", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        sizes = dealt.join(F.broadcast(centres), "list").groupBy("list").agg(F.count("*").alias("rows"), F.max(away).alias("radius"))
        table = centres.join(sizes, "list").select("list", "centre", "rows", "radius", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("cells"))
        table = spark.createDataFrame(table.collect(), kind)  # at most MAX_LISTS rows
        cell = F.pmod(F.xxhash64("vec_id"), F.col("cells")).cast("int")
        placed = dealt.join(F.broadcast(table.select("list", "cells")), "list").select("vec_id", "vector", cell.alias("cell"), "list")
    else:
        table, placed = spark.createDataFrame([], kind), rows.select("vec_id", "vector", F.lit(0).alias("cell"), F.lit(0).alias("list"))
    placed.repartition("list", "cell").write.partitionBy("list").parquet(f"{folder}/vectors")
    table.write.parquet(f"{folder}/lists")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    found = spark.read.parquet(f"{folder}/lists").orderBy("list").collect()  # at most MAX_LISTS rows
    return VectorIndex(spark, folder, np.array([r.list for r in found], np.int64), np.array([r.centre for r in found], np.float64), np.array([r.radius for r in found]), np.array([r.cells for r in found], np.int64))


def _probed(frames, numbers: np.ndarray, centres: np.ndarray, radii: np.ndarray, first: int, last: int | None):
    """Frames of at most about PROBE_ROWS rows: queries' lists from the first to the last place, whose bound reaches the query's least score if it has one."""
    step = max(1, PROBE_ROWS // max(1, len(range(len(numbers))[first:last])))
    for frame in frames:
        for at in range(0, len(frame), step):
            part = frame.iloc[at : at + step]
            q = np.array(part["query_vector"].tolist(), np.float64)
            products = q @ centres.T
            order = np.argsort(-products, axis=1, kind="stable")[:, first:last]
            bound = np.take_along_axis(products, order, 1) + np.linalg.norm(q, axis=1)[:, None] * radii[order]
            least = part["least"].to_numpy(np.float64)[:, None]
            row, column = np.nonzero(np.isnan(least) | (bound >= least - _HALF_STEP))
            yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "query_vector": part["query_vector"].to_numpy()[row], "list": numbers[order[row, column]].astype(np.int32), "place": (column + first).astype(np.int32), "bound": bound[row, column]})


def _probes(index: VectorIndex, queries: DataFrame, first: int, last: int | None) -> DataFrame:
    """(query_id, query_vector, list, place, bound): a query's lists from the first to the last place by their centres' product.

    Queries may have a column least: lists that hold no such score are left out.
    """
    known = index.spark.sparkContext.broadcast((index.numbers, index.centres, index.radii))

    def run(frames):
        return _probed(frames, *known.value, first, last)

    asked = queries.where(F.col("query_vector").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vector").cast("array<double>").alias("query_vector"), (F.col("least") if "least" in queries.columns else F.lit(None)).cast("double").alias("least"))
    if not len(index.numbers):
        return asked.drop("least").select("*", F.lit(0).alias("list"), F.lit(0).alias("place"), F.lit(0.0).alias("bound")).where("false")
    return asked.mapInPandas(run, "query_id long, query_vector array<double>, list int, place int, bound double")


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest scores of each row, equal ones by id."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    rows, columns = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[first], columns[first]


def _scored(index: VectorIndex, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, place): k rows of every cell for each query that probes it."""
    counts = {r.list: r.n for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a list
    rows = [(int(i), int(c), -(-counts[i] // CELL_ROWS)) for i, c in zip(index.numbers, index.cells, strict=True) if i in counts]
    lists = F.broadcast(index.spark.createDataFrame(rows, "list int, cells int, blocks int"))
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    asked = probes.join(lists, "list").select("query_id", "query_vector", "list", "place", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), up_to("cells").alias("cell"))
    # Partitions of lists that nobody probes are not read.
    held = index.vectors().where(F.col("list").isin([r[0] for r in rows])).join(lists.select("list", "blocks"), "list").select("vec_id", "vector", "list", "cell", up_to("blocks").alias("block"))

    def nearest(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "place": []})
        ids, many = v["vec_id"].to_numpy(), np.array(v["vector"].tolist(), np.float64)
        out = []
        for at in range(0, len(q), 1024):
            part = q.iloc[at : at + 1024]
            scores = np.round(np.array(part["query_vector"].tolist(), np.float64) @ many.T, 6) + 0.0
            row, column = best_rows(scores, ids, k)
            out.append(pd.DataFrame({"query_id": part["query_id"].to_numpy()[row], "vec_id": ids[column], "score": scores[row, column], "place": part["place"].to_numpy()[row]}))
        return pd.concat(out)

    keys = ("list", "cell", "block")
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(nearest, "query_id long, vec_id long, score double, place int")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probes_for(index: VectorIndex, queries: DataFrame, k: int = 5, recall: float = 0.95, sample: int = SAMPLE_QUERIES) -> int:
    """Lists to probe for a recall, measured on about so many of the queries against all vectors.

    What is collected is the places of the lists that hold the k best of each query of the sample.
    """
    n = queries.count()
    some = queries.where(_hashed_share("query_id", sample / max(n, 1))).limit(2 * sample)
    places = np.sort([r.place for r in _ranked(_scored(index, _probes(index, some, 0, None), k), k).select("place").collect()])
    if not len(places):
        return len(index.numbers)
    return int(places[min(len(places), int(np.ceil(recall * len(places)))) - 1]) + 1


def search_index(index: VectorIndex, queries: DataFrame, k: int = 5, probes: int = 8, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of the largest inner product among the probed lists; queries: (query_id, query_vector).

    exact=True gives the same rows as comparing all vectors: after the probed lists, those are read whose bound reaches the k-th
    score that was found.
    """
    rows = _scored(index, _probes(index, queries, 0, probes), k)
    if exact and probes < len(index.numbers):
        from ..sources.shared import written

        rows = written(_ranked(rows, k).drop("rank"), "vector-hits")
        reached = rows.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
        more = _probes(index, queries.select("query_id", "query_vector").join(reached, "query_id", "left"), probes, None)
        rows = rows.union(_scored(index, more, k))
    return _ranked(rows, k).select("query_id", "rank", "vec_id", "score")


def recall_of(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, hits, recall): the share of a query's wanted vectors (query_id, vec_id) that were found."""
    hits = wanted.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg(F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))
