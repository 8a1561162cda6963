"""Evaluation as ordinary aggregations: classes, extraction, ranking, latencies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles, with_quantiles


def ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def class_metrics(rows: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1), ratios to 4 places; every row counts for its gold and its predicted class."""
    sides = rows.select(F.col(gold).alias("g"), F.col(pred).alias("p")).groupBy("g", "p").agg(F.count("*").alias("n"))
    each = sides.select(F.explode(F.array_compact(F.array_distinct(F.array("g", "p")))).alias("class"), "g", "p", "n")
    same = lambda c: F.coalesce(F.col(c) == F.col("class"), F.lit(False))
    s = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    counted = each.groupBy("class").agg(s(same("g") & same("p")).alias("tp"), s(~same("g") & same("p")).alias("fp"), s(same("g") & ~same("p")).alias("fn"), s(same("g")).alias("support"))
    return counted.select("*", *[F.round(v, 4).alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def summary_metrics(classes: DataFrame) -> DataFrame:
    """One row: accuracy, macro means of the rounded class values, means weighted by support."""
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    return classes.agg(
        F.round(ratio(F.sum("tp"), total), 4).alias("accuracy"),
        *[F.round(F.avg(n), 4).alias(f"macro_{n}") for n in names],
        *[F.round(ratio(F.sum(F.col(n) * F.col("support")), total), 4).alias(f"weighted_{n}") for n in names],
    )


def confusion(rows: DataFrame, classes: list, gold: str = "gold", pred: str = "pred", failed: str = "EXTRACTION_FAILED") -> DataFrame:
    """A row a gold class, a column a predicted one (null predictions: failed), and their total."""
    table = rows.select(F.col(gold).cast("string").alias("gold"), F.coalesce(F.col(pred).cast("string"), F.lit(failed)).alias("p"))
    wide = table.groupBy("gold").pivot("p", [*map(str, classes), failed]).agg(F.count(F.lit(1))).na.fill(0)
    return wide.withColumn("total", sum((F.col(str(c)) for c in [*classes, failed]), F.lit(0)))


def slice_accuracy(rows: DataFrame, slices: list[str]) -> DataFrame:
    """(slice, value, n, accuracy) of each slicing column, in one pass."""
    long = rows.select(F.col("correct").cast("int").alias("ok"), F.explode(F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])).alias("s"))
    return long.groupBy("s.slice", "s.value").agg(F.count("*").alias("n"), F.round(F.avg("ok"), 4).alias("accuracy"))


def ranking_metrics(hits: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(query_id, k, precision, recall, rr, ndcg) for every query with a relevant document; hits: (query_id, doc_id, rank)."""
    grades = qrels.where("grade > 0").dropDuplicates(["query_id", "doc_id"])
    return graded_metrics(hits.join(grades, ["query_id", "doc_id"]), grades.groupBy("query_id", "grade").agg(F.count("*").alias("n")), ks)


def graded_metrics(found: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """The same from relevant hits (query_id, rank, grade) and counts of relevant documents (query_id, grade, n), which need no pairs."""
    cut = F.explode(F.array(*map(F.lit, ks)))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    places = relevant.where("grade > 0 and n > 0").select("query_id", "grade", "n", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(max(ks))).cast("int"))).alias("place"))
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "place"))
    ideal = places.withColumn("r", ideal_rank).withColumn("k", cut).groupBy("query_id", "k").agg(F.sum(F.when(F.col("place") == 1, F.col("n"))).alias("relevant"), F.sum(F.when(F.col("r") <= F.col("k"), gain(F.col("grade"), F.col("r")))).alias("ideal"))
    got = found.withColumn("k", cut).where("rank <= k").groupBy("query_id", "k")
    got = got.agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    rows = ideal.join(got, ["query_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("query_id", "k", zero(F.col("found") / F.col("k")).alias("precision"), zero(F.col("found") / F.col("relevant")).alias("recall"), zero(1 / F.col("first")).alias("rr"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg"))


def mean_metrics(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = ("precision", "recall", "rr", "ndcg")
    return per_query.groupBy("k", *(by or [])).agg(F.count("*").alias("queries"), *[F.round(F.avg(n), 6).alias(n) for n in names])


def weak_queries(per_query: DataFrame, k: int = 5) -> DataFrame:
    return per_query.where((F.col("k") == k) & ((F.col("rr") == 0) | (F.col("ndcg") < 0.85) | (F.col("recall") < 0.75)))


def no_match_accuracy(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Of queries that should find nothing, the share that does."""
    expected = queries.where("expects_no_results").select("query_id")
    empty = expected.join(hits.select("query_id").distinct().withColumn("hit", F.lit(1)), "query_id", "left")
    return empty.agg(F.count("*").alias("n"), ratio(F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)), F.count("*")).alias("accuracy"))


def distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, median, std (0 for one value), min, max, p90, p95, iqr; percentiles by nearest rank, without a task that holds a group."""
    v = F.col(value)
    whole = rows.where(v.isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    found = quantiles(rows, value, by, {"p90": 0.9, "p95": 0.95, "_q1": 0.25, "_q3": 0.75}, {"_median": 0.5})
    both = with_quantiles(whole, by, found)
    return both.select(*by, "n", "mean", F.round("_median", 6).alias("median"), "std", "min", "max", "p90", "p95", F.round(F.col("_q3") - F.col("_q1"), 6).alias("iqr"))


def balanced_mean(rows: DataFrame, value: str, document: str, by: list[str]) -> DataFrame:
    """Runs averaged a document, then documents: mean and median beside the mean over all runs."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*by, document).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count("*").alias("c"))
    whole = per.groupBy(*by).agg(F.count("*").alias("documents"), F.round(F.avg("m"), 6).alias("balanced_mean"), F.round(F.sum("s") / F.sum("c"), 6).alias("run_mean"))
    both = with_quantiles(whole, by, quantiles(per, "m", by, cont={"_median": 0.5}))
    return both.select(*by, "documents", "balanced_mean", F.round("_median", 6).alias("balanced_median"), "run_mean")


def stage_shares(rows: DataFrame, stage: str, value: str) -> DataFrame:
    """Mean of each stage and its share of all means, the dominant one marked."""
    means = rows.groupBy(stage).agg(F.avg(value).alias("m"))
    everything = Window.partitionBy()
    return means.select(stage, F.round("m", 6).alias("mean"), F.round(100 * F.col("m") / F.sum("m").over(everything), 4).alias("share"), (F.col("m") == F.max("m").over(everything)).alias("dominant"))
