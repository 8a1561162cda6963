"""Reports of classifiers, field extraction, latencies and datasets, as aggregations over tables of predictions and runs.

Rates are 0 where there is nothing to divide by. Null predictions are no class; null values are left out of means.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, normal_name
from .metrics import prf, ratio
from .quantiles import quantiles, with_quantiles

FAILED = "EXTRACTION_FAILED"
# Words that tell a text of another language in the report of errors.
FOREIGN_WORDS = ("fatura", "simplificada", "recibo", "total", "iva", "artigo", "preco", "eur")


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def grouped_metrics(rows: DataFrame, classes: list[str], by: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(by..., accuracy, macro_*, weighted_*): a row a group, over the given classes whether or not they occur in it.

    Class values are rounded to 4 places before they are averaged. Rows count for their gold and their predicted class, so the
    groups of counts are as many as there are pairs of classes.
    """
    sides = rows.groupBy(*by, F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    each = sides.select(*by, "g", "p", "n", F.explode(F.array(*map(F.lit, classes))).alias("class"))
    same = lambda c: F.coalesce(F.col(c) == F.col("class"), F.lit(False))
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    counted = each.groupBy(*by, "class").agg(total(same("g") & same("p")).alias("tp"), total(~same("g") & same("p")).alias("fp"), total(same("g") & ~same("p")).alias("fn"), total(same("g")).alias("support"))
    valued = counted.select("*", *[F.round(v, 4).alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])
    names = ("precision", "recall", "f1")
    return valued.groupBy(*by).agg(
        F.round(ratio(F.sum("tp"), F.sum("support")), 4).alias("accuracy"),
        *[F.round(F.avg(n), 4).alias(f"macro_{n}") for n in names],
        *[F.round(ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")), 4).alias(f"weighted_{n}") for n in names],
    )


def population_metrics(rows: DataFrame, classes: list[str], systems: tuple[str, ...] = ("production", "raw"), gold: str = "gold", extracted: str = "extracted") -> DataFrame:
    """Metrics of each system over all rows, and over those whose text could be extracted."""
    populations = F.array_compact(F.array(F.lit("all"), F.when(F.col(extracted), F.lit("extracted"))))
    step = rows.select(gold, *systems, F.explode(populations).alias("population"))
    long = step.select(F.col(gold).alias("gold"), "population", F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("pred")) for s in systems])).alias("s")).select("gold", "population", "s.*")
    return grouped_metrics(long, classes, ["population", "system"])


def confusion_totals(table: DataFrame) -> DataFrame:
    """A confusion table with a last row of column totals."""
    counts = [c for c in table.columns if c != "gold"]
    return table.union(table.agg(F.lit("total_predicted").alias("gold"), *[F.sum(c).alias(c) for c in counts]))


def confidence_statistics(rows: DataFrame, correct: str = "correct", confidence: str = "confidence") -> DataFrame:
    """Mean confidence of right and wrong rows, the least of right ones and the largest of wrong ones; null where there are none."""
    of = lambda wanted: F.when(F.col(correct) == F.lit(wanted), F.col(confidence))
    return rows.agg(F.round(F.avg(of(True)), 4).alias("mean_correct"), F.round(F.avg(of(False)), 4).alias("mean_incorrect"), F.round(F.min(of(True)), 4).alias("min_correct"), F.round(F.max(of(False)), 4).alias("max_incorrect"))


def heuristic_effect(rows: DataFrame, heuristic: str = "heuristic", raw: str = "raw") -> DataFrame:
    """How often wording decided, and how often against the model (a missing model label counts as against)."""
    fired = F.col(heuristic).isNotNull()
    return rows.agg(F.count_if(fired).alias("triggered"), F.count_if(fired & ~F.col(heuristic).eqNullSafe(F.col(raw))).alias("diverged"))


def error_cause(text: Column, extracted: Column) -> Column:
    """Why a row went wrong: no text, words of another language, or the classifier itself."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(~F.coalesce(extracted, F.lit(False)) | (F.length(low) < 10), F.lit("PROCESSING_FAILURE")).when(low.rlike("|".join(FOREIGN_WORDS)), F.lit("CROSS_LINGUAL_VOCABULARY")).otherwise(F.lit("CLASSIFIER_GENERALIZATION"))


def error_causes(wrong: DataFrame, text: str = "text", extracted: str = "extracted") -> DataFrame:
    return wrong.groupBy(error_cause(F.col(text), F.col(extracted)).alias("cause")).agg(F.count("*").alias("n"))


def error_samples(errors: DataFrame, by: list[str], order: str, error: str = "error", most: int = 3, size: int = 180) -> DataFrame:
    """The first errors of each group, cut to a length."""
    first = Window.partitionBy(*by).orderBy(order)
    return errors.where(F.col(error).isNotNull()).withColumn("sample", F.row_number().over(first)).where(F.col("sample") <= most).withColumn(error, F.substring(error, 1, size))


def form_field(label: Column) -> Column:
    """The field that a form's label asks for: numbers before dates before amounts before suppliers; else null."""
    low = normal_name(label)
    has = lambda *words: F.greatest(F.lit(False), *[low.contains(w) for w in words])
    # The words that tell a field.
    return (
        F.when(low == "", F.lit(None).cast("string"))
        .when(has("invoice", " id", " no", "number"), F.lit("invoice_number"))
        .when(has("date"), F.lit("date"))
        .when(has("total", "amount", "balance", "price") | label.contains("$"), F.lit("amount"))
        .when(has("company", "vendor", "from", "supplier"), F.lit("supplier"))
    )


def target_scores(predictions: DataFrame, targets: DataFrame) -> DataFrame:
    """(field, tp, fp, fn, precision, recall, f1) of predictions (doc_id, field, value) against sets (doc_id, field, targets).

    A match is loose: equal, or one holds the other. A prediction that matches nothing is false, and what it missed is missed.
    """
    value = comparable(F.col("value"))
    alike = lambda t: (t != "") & (value != "") & (value.contains(t) | t.contains(value))
    rows = predictions.join(targets, ["doc_id", "field"], "left").select("field", value.alias("v"), F.coalesce(F.exists("targets", lambda t: alike(comparable(t))), F.lit(False)).alias("hit"), (F.coalesce(F.size("targets"), F.lit(0)) > 0).alias("wanted"))
    counted = rows.groupBy("field").agg(_count(F.col("hit")).alias("tp"), _count((F.col("v") != "") & ~F.col("hit")).alias("fp"), _count(F.col("wanted") & ~F.col("hit")).alias("fn"))
    return counted.select("*", *[F.round(v, 4).alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def extraction_scores(rows: DataFrame, slices: list[str]) -> DataFrame:
    """Presence and exact match of fields, over all and by each slice: rows (status, expected, extracted, slices...).

    status: PRESENT, NOT_PRESENT or AMBIGUOUS (left out of presence). Exact match is over PRESENT and ignores case,
    punctuation and runs of blanks.
    """
    found = F.coalesce(F.col("extracted"), F.lit("")) != ""
    is_ = lambda s: F.col("status") == s
    exact = found & (comparable(F.col("extracted")) == comparable(F.col("expected")))
    long = rows.select("status", "expected", "extracted", F.explode(F.array(F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")), *[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])).alias("s"))
    counted = long.groupBy("s.slice", "s.value").agg(
        _count(is_("PRESENT") & found).alias("tp"), _count(is_("NOT_PRESENT") & found).alias("fp"), _count(is_("PRESENT") & ~found).alias("fn"),
        _count(is_("PRESENT")).alias("support"), _count(is_("NOT_PRESENT")).alias("not_present"), _count(is_("AMBIGUOUS")).alias("ambiguous"), _count(is_("PRESENT") & exact).alias("exact"),
    )
    return counted.select("*", *[F.round(v, 4).alias(k) for k, v in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()], F.round(ratio(F.col("exact"), F.col("support")), 4).alias("exact_match"))


def warning_effect(rows: DataFrame, correct: str = "correct", warned: str = "warned") -> DataFrame:
    """Wrong rows with and without a warning, right rows with one."""
    right, said = F.col(correct), F.col(warned)
    return rows.agg(_count(~right & said).alias("wrong_warned"), _count(~right & ~said).alias("wrong_not_warned"), _count(right & said).alias("right_warned"))


def cold_and_steady(runs: DataFrame) -> DataFrame:
    """Runs (document, modality, cold, seconds) to a row a document with a cold run: how much longer it took than its steady runs, and than the modality's."""
    per = runs.groupBy("modality", "document").agg(F.min(F.when(F.col("cold"), F.col("seconds"))).alias("cold"), F.avg(F.when(~F.col("cold"), F.col("seconds"))).alias("steady"))
    whole = per.groupBy("modality").agg(F.avg("steady").alias("whole"))
    rows = per.where("cold is not null").join(whole, "modality")
    own = F.coalesce("steady", "whole")
    return rows.select("modality", "document", F.round("cold", 4).alias("cold_s"), F.round(own, 4).alias("steady_s"), F.round(F.col("cold") - own, 4).alias("overhead_s"), F.when(own > 0, F.round(F.try_divide(F.col("cold"), own), 2)).otherwise(F.lit(0.0)).alias("factor"), F.round(F.col("cold") - F.col("whole"), 4).alias("overhead_of_modality_s"))


def latency_summary(stages: DataFrame, by: list[str]) -> DataFrame:
    """Stage times (by..., document, stage, seconds) to a row a group: documents, mean, median, least, most, and what was slowest.

    Ties go to the largest name. A document's time is the sum of its stages; stages without a time count nothing.
    """
    timed = stages.where("seconds is not null")
    per = timed.groupBy(*by, "document").agg(F.sum("seconds").alias("total"), F.max(F.struct("seconds", "stage")).alias("stage"))
    stat = lambda c: F.round(c, 6)
    whole = per.groupBy(*by).agg(
        F.count("*").alias("documents"), stat(F.avg("total")).alias("mean"), stat(F.min("total")).alias("min"), stat(F.max("total")).alias("max"),
        F.max(F.struct("total", "document")).alias("_d"), F.max("stage").alias("_s"),
    )
    both = with_quantiles(whole, by, quantiles(per, "total", by, cont={"_median": 0.5}))
    return both.select(
        *by, "documents", "mean", stat(F.col("_median")).alias("median"), "min", "max", F.col("_d.document").alias("slowest_document"),
        F.col("_s.stage").alias("slowest_stage"), stat(F.col("_s.seconds")).alias("slowest_stage_s"),
    )


def downstream(means: DataFrame, by: list[str], stages: list[str], stage: str = "stage", mean: str = "mean") -> DataFrame:
    """The sum of the named stages' means."""
    return means.where(F.col(stage).isin(stages)).groupBy(*by).agg(F.round(F.sum(mean), 6).alias("downstream"))


def success_rates(runs: DataFrame, by: list[str], success: str = "success") -> DataFrame:
    return runs.groupBy(*by).agg(F.count("*").alias("n"), _count(F.col(success)).alias("succeeded"), F.round(ratio(_count(F.col(success)), F.count("*")), 4).alias("rate"))


def failures(runs: DataFrame, columns: list[str], success: str = "success") -> DataFrame:
    return runs.where(~F.coalesce(F.col(success), F.lit(False))).select(*columns)


def dataset_counts(examples: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return examples.groupBy(split, label).agg(F.count("*").alias("n"))


def detection_rate(rows: DataFrame, wanted: str, share: float, key: str, status: str = "status", pred: str = "pred") -> DataFrame:
    """A sample (by a hash of the key) of documents of one class: how many were read, skipped by reason, and found to be of it."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("long")
    sample = rows.where(bucket < int(share * 65536))
    read = F.col(status) == "ok"
    return sample.agg(F.count("*").alias("sampled"), _count(read).alias("read"), _count(F.col(status) == "unreadable").alias("unreadable"), _count(F.col(status) == "empty").alias("empty"), _count(read & (F.col(pred) == wanted)).alias("detected"), F.round(ratio(_count(read & (F.col(pred) == wanted)), _count(read)), 4).alias("rate"))


def raw_and_production(rows: DataFrame, gold: str = "gold", raw: str = "raw", production: str = "production") -> DataFrame:
    """rows with both predictions judged side by side (a missing one is wrong)."""
    ok = lambda c: F.coalesce(F.col(c) == F.col(gold), F.lit(False))
    return rows.select("*", ok(raw).alias("raw_correct"), ok(production).alias("production_correct"))


def compared_models(one: DataFrame, other: DataFrame, band: float = 1e-4) -> DataFrame:
    """Two one-row summaries to their differences (other less one) and what that amounts to."""
    a = one.select(F.col("accuracy").alias("a1"), F.col("macro_f1").alias("f1"))
    b = other.select(F.col("accuracy").alias("a2"), F.col("macro_f1").alias("f2"))
    d = F.col("f2") - F.col("f1")
    outcome = F.when(d > band, F.lit("improved")).when(d < -band, F.lit("reduced")).otherwise(F.lit("matched"))
    return a.join(F.broadcast(b)).select(F.round(F.col("a2") - F.col("a1"), 4).alias("delta_accuracy"), F.round(d, 4).alias("delta_macro_f1"), outcome.alias("outcome"))
