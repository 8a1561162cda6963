"""Features of a text's layout, and a classifier over words and layout."""

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, Normalizer, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let
from ..functions.text import strip
from .extract import AMOUNT, DATE

# The keywords that are counted, by feature.
TOP = {
    "top_region_invoice_keyword_count": ("invoice", "invoice no", "invoice number", "inv"),
    "top_region_receipt_keyword_count": ("receipt", "cashier", "tender", "change"),
    "top_region_po_keyword_count": ("purchase order", "po number", "order number", "supplier"),
}
SIGNS = ("$", "Rs", "RM")
TOTALS = ("total", "grand total", "balance due", "amount payable")
WHOLE = {
    "supplier_label_count": ("supplier", "supplier name", "vendor", "company name"),
    "bill_to_ship_to_count": ("bill to", "ship to"),
    "cashier_keyword_count": ("cashier",),
    "change_keyword_count": ("change",),
    "payment_keyword_count": ("payment", "paid", "cash", "card", "tender"),
    "item_table_keyword_count": ("qty", "quantity", "unit price", "uom", "item", "description", "sku"),
    "purchase_order_keyword_count": ("purchase order", "po number", "order number"),
    "receipt_keyword_count": ("receipt", "cashier", "tender"),
    "invoice_keyword_count": ("invoice", "invoice no", "invoice number", "balance due"),
}


def _count(text: Column, word: str) -> Column:
    """How often a word of ASCII stands in the text, without overlaps."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(word), F.lit("")))) / F.lit(len(word))


def _counts(text: Column, *lists: tuple[str, ...]) -> Column:
    """An array: for each list how often its words stand in the text. Each word is looked for once, and only where a part of it was found."""
    words = sorted({w for words in lists for w in words}, key=lambda w: (len(w), w))
    part = {w: next((v for v in words if v != w and v in w), None) for w in words}
    roots = [w for w in words if part[w] is None]
    rest = [w for w in words if part[w] is not None]

    def summed(r: Column) -> Column:
        seen = F.array(*[F.when(r[roots.index(part[w])] > 0, _count(text, w)).otherwise(F.lit(0.0)) for w in rest]) if rest else F.array(F.lit(0.0))
        return let(seen, lambda s: F.array(*[sum((r[roots.index(w)] if w in roots else s[rest.index(w)] for w in words), F.lit(0.0)) for words in lists]))

    return let(F.array(*[_count(text, w) for w in roots]), summed)


def layout_features(text: Column) -> Column:
    """A struct of 25 doubles: lengths, shares, keywords of the whole text and of its top and bottom quarter, density.

    A region is a quarter of the lines (at least one) and 500 characters beside them. A null text is empty.
    """
    return let(let(F.coalesce(text, F.lit("")), _parts), _features)


def _parts(t: Column) -> Column:
    """What several features read, each computed once a row."""
    split = F.array_remove(F.transform(F.split(F.regexp_replace(t, r"\r\n?|[\x0B\f\x1C-\x1E\x85\u2028\u2029]", "\n"), "\n"), strip), F.lit(""))

    def regions(lines: Column) -> Column:
        n = F.size(lines)
        size = F.greatest(F.ceil(n * 0.25).cast("int"), F.lit(1))
        region = lambda part, chars: F.lower(F.concat(F.when(n > 0, F.array_join(part, "\n")).otherwise(F.lit("")), F.lit("\n"), chars))
        widths = F.transform(lines, lambda x: F.length(x))
        return F.struct(
            t.alias("t"),
            n.alias("n"),
            F.coalesce(F.array_max(widths), F.lit(0)).alias("widest"),
            F.length(F.array_join(lines, "")).cast("long").alias("width"),
            region(F.slice(lines, F.lit(1), size), F.substring(t, 1, 500)).alias("top"),
            region(F.slice(lines, F.greatest(n - size + 1, F.lit(1)), size), F.when(F.length(t) > 500, F.substring(t, -500, 500)).otherwise(t)).alias("bottom"),
            F.lower(t).alias("low"),
            F.regexp_replace(t, r"(?U)\s+", "").alias("solid"),
        )

    return let(split, regions)


def _features(p: Column) -> Column:
    counted = F.struct(_counts(p["t"], SIGNS).alias("signs"), _counts(p["top"], *TOP.values()).alias("top"), _counts(p["bottom"], TOTALS).alias("bottom"), _counts(p["low"], *WHOLE.values()).alias("low"))
    return let(counted, lambda k: _values(p, k))


def _values(p: Column, k: Column) -> Column:
    t, n, whole = p["t"], p["n"], dict(zip(WHOLE, (k["low"][i] for i in range(len(WHOLE))), strict=True))
    share = lambda pattern: F.length(F.regexp_replace(p["solid"], pattern, "")) / F.greatest(F.length(p["solid"]), F.lit(1))
    # Few texts have what every amount or date has: the long patterns try each place of those only.
    among = lambda sign, pattern: F.when(t.rlike(sign), F.regexp_count(t, F.lit("(?i)" + pattern))).otherwise(F.lit(0))
    values = {
        "char_count": F.length(t),
        "word_count": F.regexp_count(t, F.lit(r"(?U)\b[\w'-]+\b")),
        "line_count": n,
        "average_line_length": F.when(n > 0, p["width"] / n).otherwise(F.lit(0.0)),
        "max_line_length": p["widest"],
        "digit_ratio": share(r"\P{Nd}+"),
        "uppercase_ratio": share(r"\P{Lu}+"),
        "currency_symbol_count": k["signs"][0],
        "amount_like_count": among(r"\.\d\d", AMOUNT),
        "date_like_count": among(r"\d", DATE),
        **{name: k["top"][i] for i, name in enumerate(TOP)},
        "bottom_region_total_keyword_count": k["bottom"][0],
        **whole,
        "line_item_density_proxy": whole["item_table_keyword_count"] / F.greatest(n, F.lit(1)),
        "total_near_bottom_proxy": F.when(k["bottom"][0] > 0, 1.0).otherwise(0.0),
    }
    return F.struct(*[v.cast("double").alias(name) for name, v in values.items()])


NAMES = ("char_count", "word_count", "line_count", "average_line_length", "max_line_length", "digit_ratio", "uppercase_ratio", "currency_symbol_count", "amount_like_count", "date_like_count", *TOP, "bottom_region_total_keyword_count", *WHOLE, "line_item_density_proxy", "total_near_bottom_proxy")


def layout_classifier(train: DataFrame, label: str = "label", text: str = "text", features: int = 1 << 14) -> PipelineModel:
    """TF-IDF of one and two words beside the standardised layout features (column layout), logistic regression."""
    stages = [
        StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="_t", pattern=r"\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="_t", outputCol="_g"),
        HashingTF(inputCol="_t", outputCol="_f1", numFeatures=features),
        HashingTF(inputCol="_g", outputCol="_f2", numFeatures=features),
        VectorAssembler(inputCols=["_f1", "_f2"], outputCol="_f"),
        IDF(inputCol="_f", outputCol="_i"),
        Normalizer(inputCol="_i", outputCol="_n"),
        VectorAssembler(inputCols=list(NAMES), outputCol="_l"),
        StandardScaler(inputCol="_l", outputCol="_s", withMean=True),
        VectorAssembler(inputCols=["_n", "_s"], outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", standardization=False, regParam=1e-3, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(with_layout(train, text))


def with_layout(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one column for each layout feature."""
    return docs.select("*", layout_features(F.col(text)).alias("_layout")).select(*docs.columns, "_layout.*")
