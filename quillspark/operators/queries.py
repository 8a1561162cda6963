"""A table of natural-language queries, parsed into typed bounds. Every clause edits the running text that the next one reads."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, normal_name, strip
from ..functions.values import query_amount, query_date
from ..sources.shared import written

# The wording of clauses, in the order in which they are tried.
# 'pos' behind another type's word is a part of a name ('receipts from POS Trading Company').
TYPES = (("purchase_order", r"(?i)\b(?:purchase\s*orders?|po|pos(?<!\b(?:purchase\s{0,9}orders?|invoices?|receipts?)\b.{0,400}pos))\b"), ("invoice", r"(?i)\binvoices?\b"), ("receipt", r"(?i)\breceipts?\b"))
NUMBER = r"(?i)\b(?:po|invoice|receipt)\s+(?:number\s+)?([A-Za-z]*\d[A-Za-z0-9\-_]*)\b"
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_DATE = rf"(?:\d{{4}}[./-]\d{{1,2}}[./-]\d{{1,2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{2,4}}|\d{{1,2}}(?:st|nd|rd|th)?(?:\s+of)?\s+{_MONTH}\s*,?\s+\d{{4}}|{_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?\s*,?\s+\d{{4}})"
DATE_RANGE = rf"\b(?:between|from)\s+({_DATE})\s+(?:and|to)\s+({_DATE})\b"
DATES = (
    ("date_gte", rf"\b(?:on\s+or\s+after|on/after|from)\s+({_DATE})\b"),
    ("date_gt", rf"\b(?:after|later\s+than|above|over)\s+({_DATE})\b"),
    ("date_lte", rf"\b(?:on\s+or\s+before|on/before|up\s+to|until|through)\s+({_DATE})\b"),
    ("date_lt", rf"\b(?:before|earlier\s+than|prior\s+to|below|under)\s+({_DATE})\b"),
    ("date_eq", rf"\b(?:on|dated|date(?:\s+is)?)\s+({_DATE})\b"),
)
INCOMPLETE = (
    rf"(?i)\b(?:after|later\s+than|before|earlier\s+than|prior\s+to|on\s+or\s+after|on\s+or\s+before|on|dated)\s+(?:\d{{4}}|{_MONTH}\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?(?:\s+of)?\s+{_MONTH})\b"
    rf"|\b(?:above|over|below|under)\s+(?:{_MONTH}\s+\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)?(?:\s+of)?\s+{_MONTH})\b"
)
INCOMPLETE_ERROR = "Date filters require a complete day, month, and year, for example: after 1st January 2026."
_MONEY = r"[A-Za-z\$€£¥₹\.]*\s*[\d\,\.]+"
AMOUNT_RANGE = rf"\b(?:between|from)\s+({_MONEY})\s+(?:and|to)\s+({_MONEY})\b"
AMOUNTS = (
    ("amount_lt", rf"\b(?:below|under|less than|amount below|amount under)\s+({_MONEY})\b"),
    ("amount_lte", rf"\b(?:up to|at most)\s+({_MONEY})\b|\b({_MONEY})\s+or less\b"),
    ("amount_gt", rf"\b(?:above|over|greater than|amount above)\s+({_MONEY})\b"),
    ("amount_gte", rf"\b(?:at least)\s+({_MONEY})\b|\b({_MONEY})\s+or more\b"),
    ("amount_eq", rf"\b(?:amount|for)\s*(?:=|is)?\s*({_MONEY})\b"),
)
FROM_SUPPLIER = r"(?i)\b(?:from|supplier)\s+([A-Za-z0-9\s]+?)(?:\s+(?:below|under|over|above|for|amount)|$)"


def _drop_first(text: Column, pattern: Column) -> Column:
    return F.regexp_replace(text, F.concat(F.lit("(?is)^(.*?)(?:"), pattern, F.lit(")")), F.lit("$1"))


def _range(df: DataFrame, pattern: str, read, low: str, high: str, valid) -> DataFrame:
    """Bounds low and high where the range stands; _ranged tells whether its wording does."""
    p = "(?i)" + pattern
    step = df.select("*", F.col("rest").rlike(p).alias("_ranged"), read(F.regexp_extract("rest", p, 1)).alias("_a"), read(F.regexp_extract("rest", p, 2)).alias("_b"))
    good = F.col("_ranged") & F.coalesce(valid(F.col("_a"), F.col("_b")), F.lit(False))
    step = step.withColumns({low: F.when(good, F.col("_a")), high: F.when(good, F.col("_b")), "rest": F.when(good, _drop_first(F.col("rest"), F.lit(pattern))).otherwise(F.col("rest"))})
    return step.drop("_a", "_b")


def _first_clause(df: DataFrame, clauses, read) -> DataFrame:
    """The first clause whose wording stands (where no range does) gives its bound; the wording is cut out if it can be read."""
    which = F.coalesce(*[F.when(~F.col("_ranged") & F.col("rest").rlike("(?i)" + p), F.lit(i)) for i, (_, p) in enumerate(clauses)])
    step = df.select("*", which.alias("_which"))
    pattern = F.get(F.array(*[F.lit(p) for _, p in clauses]), F.col("_which"))
    whole = F.concat(F.lit("(?i)"), pattern)
    groups = F.get(F.array(*[F.lit(2 if "|\\b(" in p and p.count(f"({_MONEY})") == 2 else 1) for _, p in clauses]), F.col("_which"))
    first = F.expr("regexp_extract(rest, _pattern, 1)")
    step = step.select("*", whole.alias("_pattern"), pattern.alias("_plain"), groups.alias("_groups"))
    second = F.when(F.col("_groups") == 2, F.expr("regexp_extract(rest, if(_groups = 2, _pattern, '()()'), 2)"))
    step = step.select("*", read(F.coalesce(F.nullif(first, F.lit("")), second)).alias("_value"))
    got = F.col("_value").isNotNull() & F.col("_which").isNotNull()
    bounds = {name: F.when(F.col("_which") == i, F.col("_value")) for i, (name, _) in enumerate(clauses)}
    step = step.withColumns(bounds | {"rest": F.when(got, _drop_first(F.col("rest"), F.col("_plain"))).otherwise(F.col("rest"))})
    return step.drop("_which", "_pattern", "_plain", "_groups", "_value")


def parse_queries(queries: DataFrame, suppliers: DataFrame | None = None, text: str = "query") -> DataFrame:
    """queries with document_type, document_number, date_*, amount_*, supplier, semantic_text, error.

    suppliers: (supplier) names known to the corpus; the longest that the query names wins, equal lengths by name. Without any
    known supplier the wording 'from X' or 'supplier X' names one. A blank query has an error instead of bounds.
    """
    keep = queries.columns
    df = queries.select("*", F.coalesce(F.col(text), F.lit("")).alias("rest"))
    kind = F.coalesce(*[F.when(F.col("rest").rlike(p), F.lit(t)) for t, p in TYPES])
    df = df.select("*", kind.alias("document_type"), F.nullif(F.regexp_extract("rest", NUMBER, 1), F.lit("")).alias("document_number"))
    bare = F.coalesce(*[F.when(F.col("document_type") == t, F.regexp_replace("rest", p, "")) for t, p in TYPES], F.col("rest"))
    df = df.withColumn("rest", bare)
    quoted = F.concat(F.lit(r"\b(?:number\s+)?\Q"), F.col("document_number"), F.lit(r"\E\b"))
    df = df.withColumn("rest", F.when(F.col("document_number").isNotNull(), _drop_first(F.col("rest"), quoted)).otherwise(F.col("rest")))
    df = _range(df, DATE_RANGE, query_date, "date_min", "date_max", lambda a, b: a <= b)
    df = _first_clause(df, DATES, query_date)
    dated = F.coalesce(*[F.col(n) for n, _ in DATES]).isNotNull() | F.col("_ranged")
    df = df.withColumn("date_error", F.when(~dated & F.col("rest").rlike(INCOMPLETE), F.lit(INCOMPLETE_ERROR))).drop("_ranged")
    df = _range(df, AMOUNT_RANGE, query_amount, "amount_min", "amount_max", lambda a, b: a.isNotNull() & b.isNotNull())
    df = _first_clause(df, AMOUNTS, query_amount).drop("_ranged")
    df = _with_supplier(df, suppliers) if suppliers is not None else _worded_supplier(df)
    blank = strip(F.coalesce(F.col(text), F.lit(""))) == ""
    error = F.when(blank, F.lit("query is required")).otherwise(F.col("date_error"))
    names = ["document_type", "document_number", "supplier", *[f"date_{x}" for x in ("eq", "lt", "lte", "gt", "gte", "min", "max")], *[f"amount_{x}" for x in ("eq", "lt", "lte", "gt", "gte", "min", "max")]]
    return df.select(*keep, *names, strip(collapse(F.col("rest"))).alias("semantic_text"), error.alias("error"))


def _worded_supplier(df: DataFrame) -> DataFrame:
    named = F.col("rest").rlike(FROM_SUPPLIER)
    return df.withColumns({"supplier": F.when(named, strip(F.regexp_extract("rest", FROM_SUPPLIER, 1))), "rest": F.when(named, _drop_first(F.col("rest"), F.lit(FROM_SUPPLIER[4:]))).otherwise(F.col("rest"))})


def known_names(suppliers: DataFrame) -> DataFrame:
    """(_n, _s, _w): different normalised names, the least spelling of each, and the word that the fewest names have (then the first)."""
    names = suppliers.select(F.col("supplier").alias("_s"), normal_name(F.col("supplier")).alias("_n")).where("_n != ''").groupBy("_n").agg(F.min("_s").alias("_s"))
    words = names.select("_n", F.explode(F.array_distinct(F.split("_n", " "))).alias("_w"))
    held = words.groupBy("_w").agg(F.count("*").alias("_names"))
    rarest = words.join(held, "_w").groupBy("_n").agg(F.min(F.struct("_names", "_w")).alias("_k"))
    return names.join(rarest, "_n").select("_n", "_s", F.col("_k._w").alias("_w"))


def _with_supplier(df: DataFrame, suppliers: DataFrame) -> DataFrame:
    """The longest known name that stands in the query as whole words.

    Every name waits under its rarest word, so words that many names share ('the', 'company') bring queries and names together only
    where a name has no other; different texts are looked up once.
    """
    # Read twice; and predicates pushed through the clauses above would copy them into themselves.
    texts = written(df.withColumn("_t", normal_name(F.col("rest"))), "query-texts")
    words = texts.select("_t").distinct().select("_t", F.explode(F.array_distinct(F.split("_t", " "))).alias("_w"))
    inside = F.concat(F.lit(" "), F.col("_t"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("_n"), F.lit(" ")))
    best = words.join(known_names(suppliers), "_w").where(inside).groupBy("_t").agg(F.max_by(F.struct("_s", "_n"), F.struct(F.length("_n"), F.col("_n"))).alias("_b"))
    found = texts.join(best, "_t", "left")
    pattern = F.concat(F.lit(r"(?i)\b(?:from\s+|supplier\s+|vendor\s+|documents\s+from\s+)?"), F.array_join(F.split("_b._n", " "), r"[\s\.,;:\-'\"]*"), F.lit(r"\b"))
    return found.withColumns({"supplier": F.col("_b._s"), "rest": F.when(F.col("_b").isNotNull(), F.regexp_replace(F.col("rest"), pattern, F.lit(" "))).otherwise(F.col("rest"))}).drop("_t", "_b")
