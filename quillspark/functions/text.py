"""Text and scalar functions, as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query, and what is searched along with a word.
STOP_WORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "or", "the", "to", "with"]
SYNONYMS = {
    "po": ["purchase", "order"],
    "purchase": ["po"],
    "order": ["po"],
    "balance": ["total", "amount"],
    "due": ["payable"],
    "payable": ["due", "amount"],
    "paid": ["payment", "cash"],
    "payment": ["paid"],
    "supplier": ["vendor", "company"],
    "company": ["supplier"],
    "screenline": ["supplier", "vendor"],
    "superstore": ["supplier", "vendor"],
    "aeon": ["supplier", "receipt"],
    "quantum": ["supplier", "receipt"],
    "logic": ["supplier", "receipt"],
    "gst": ["tax"],
    "tax": ["gst"],
}


def filled(text: Column) -> Column:
    """text, or null where it is empty; unlike nullif() it holds its argument once, which matters where that is a long expression."""
    return F.get(F.array_remove(F.array(text), F.lit("")), F.lit(0))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none or it is empty."""
    return filled(F.regexp_extract(text, pattern, group))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column) -> Column:
    """As strip(collapse(text)): what stays at the ends of collapsed text is one space."""
    return F.trim(collapse(text))


def clean_text(text: Column) -> Column:
    """LF line ends, single spaces, no more than one blank line in a row, no white space at the ends."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(unix, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def clean_value(text: Column) -> Column:
    """Single spaces, no punctuation at the ends; null where nothing stays."""
    return filled(F.btrim(collapse(text), F.lit(" .,:;-")))


def normal_name(text: Column) -> Column:
    """Lower case, ASCII punctuation as spaces, single spaces; a null name is empty."""
    return compact(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\p{Punct}", " "))


def comparable(text: Column) -> Column:
    """Lower case, single spaces, ASCII punctuation deleted."""
    return F.regexp_replace(collapse(strip(F.lower(F.coalesce(text, F.lit(""))))), r"\p{Punct}", "")


def alike(a: Column, b: Column) -> Column:
    """Equal, or one holds the other, when compared loosely; empty ones are not alike."""
    x, y = comparable(a), comparable(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def preview(text: Column, size: int = 1000) -> Column:
    return F.substring(compact(text), 1, size)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")).cast("long")


def chunk_tokens(text: Column) -> Column:
    """Estimated tokens of a chunk: a quarter of its characters, at least 1 unless it is empty."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


def document_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case words and numbers without stop words, each followed by its synonyms."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.element_at(table, w), F.array().cast("array<string>")))))


def token_bucket(token: Column, buckets: int = 256) -> Column:
    """A polynomial hash with base 131."""
    return F.aggregate(F.split(token, ""), F.lit(0).cast("long"), lambda h, c: F.pmod(h * 131 + F.ascii(c), F.lit(buckets))).cast("int")


def highlight(text: Column, query: Column) -> Column:
    """Whole words of the query with three letters or more between ** in the text, the longest first."""
    terms = F.array_distinct(F.filter(F.split(strip(query), r"(?U)\s+"), lambda t: F.length(t) >= 3))
    ordered = F.transform(F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: F.regexp_replace(x["t"], r"([^A-Za-z0-9\s])", r"\\$1"))
    pattern = F.concat(F.lit("(?i)\\b("), F.array_join(ordered, "|"), F.lit(")\\b"))
    return F.when(F.size(terms) > 0, F.regexp_replace(text, pattern, F.lit("**$1**"))).otherwise(text)


def parse_json_map(value: Column) -> Column:
    """An object's fields as a map of strings; what is no object gives an empty map."""
    return F.coalesce(F.from_json(value, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
