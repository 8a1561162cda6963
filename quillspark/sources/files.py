"""Readers of document files and page tables, as frames of text."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, collapse, strip
from ..operators.ordering import in_order, numbered_rows

IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp")
TEXTS = ("txt", "md", "html", "json", "csv")


def kind_of(path: Column) -> Column:
    """pdf, image, or a text format by extension; null where it is not supported."""
    e = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(e == "pdf", F.lit("pdf")).when(e.isin(*IMAGES), F.lit("image")).when(e.isin(*TEXTS, "docx"), e)


# What the bytes 80 to 9F stand for in code page 1252 (undefined ones as they are).
_CP1252 = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def decoded(content: Column) -> Column:
    """UTF-8 text without a mark; bytes that are no UTF-8 are read as code page 1252, which is Latin-1 but for 80 to 9F."""
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), _CP1252)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(latin)
    return F.regexp_replace(text, "^﻿", "")


def read_texts(spark: SparkSession, folder: str, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(texts, rejected) of a folder, read recursively; names that hold one of exclude are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", name.alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_time"), kind_of(F.col("path")).alias("kind"), F.sha2("content", 256).alias("file_hash"), "content")
    for x in exclude:
        rows = rows.where(~F.col("filename").contains(x))
    good = rows.where(F.col("kind").isin(*TEXTS)).withColumn("text", clean_text(decoded(F.col("content")))).drop("content")
    return good, rows.where(F.col("kind").isNull() | ~F.col("kind").isin(*TEXTS)).select("path", F.lit("unsupported").alias("error"))


def json_text(value: Column) -> Column:
    """An object as lines 'key: value', a list as lines 'Item i: value' from 1; any other value as it is, null where it is no JSON."""
    whole = F.trim(value)
    said = lambda v: F.coalesce(v, F.lit("None"))
    pairs = F.transform(F.map_entries(F.from_json(whole, "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), said(e["value"])))
    items = F.transform(F.from_json(whole, "array<string>"), lambda v, i: F.concat(F.lit("Item "), (i + 1).cast("string"), F.lit(": "), said(v)))
    plain = F.when(F.get_json_object(F.concat(F.lit('{"v":'), whole, F.lit("}")), "$.v").isNotNull() | (whole == "null"), F.when(whole == "null", F.lit("None")).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), whole, F.lit("}")), "$.v")))
    return F.when(whole.startswith("{"), F.array_join(pairs, "\n")).when(whole.startswith("["), F.array_join(items, "\n")).otherwise(plain)


def row_line(columns: list[str], number: Column) -> Column:
    """'Row n: h: v | h: v'."""
    cells = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    return F.concat(F.lit("Row "), number.cast("string"), F.lit(": "), cells)


def csv_lines(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(row, text) of a table in the order of a column (nulls first, ties in any order): its lines, numbered from 1.

    No task holds the table; write the result sorted by row as text.
    """
    kept = in_order(rows.select(*dict.fromkeys([*columns, order])), F.col(order).asc_nulls_first())
    return numbered_rows(kept).select("row", row_line(columns, F.col("row")).alias("text"))


def csv_texts(files: DataFrame) -> DataFrame:
    """(path, text, dropped) of CSV files (path, content): a header line, a blank line, a line a row; rows of another width are dropped and counted.

    A file is one document, so its text is one value; quotes follow the usual rules, without line breaks inside a cell.
    """
    cell = r'("(?:[^"]|"")*"|[^,"]*)(?:,|$)'
    bare = lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, 2, 2147483647).substr(F.lit(1), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    cells = lambda line: F.transform(F.regexp_extract_all(F.regexp_replace(line, ",$", ',""'), F.lit(cell), F.lit(1)), bare)
    parsed = lambda line: F.transform(F.array(line), cells)[0]
    lines = F.filter(F.split(decoded(F.col("content")), r"\r\n|\n|\r"), lambda x: x != "")
    split = files.select("path", F.transform(lines, lambda x: _trimmed_cells(parsed(x))).alias("_rows"))
    head = F.get("_rows", F.lit(0))
    good = F.filter(F.slice("_rows", 2, 1 << 30), lambda r: F.size(r) == F.size(F.get("_rows", F.lit(0))))
    told = lambda r, i: F.concat(F.lit("Row "), (i + 1).cast("string"), F.lit(": "), F.array_join(F.zip_with(F.get("_rows", F.lit(0)), r, lambda h, v: F.concat(h, F.lit(": "), v)), " | "))
    text = F.concat(F.lit("Headers: "), F.array_join(head, ", "), F.lit("\n\n"), F.array_join(F.transform(good, told), "\n"))
    return split.where(F.size("_rows") > 0).select("path", text.alias("text"), (F.size("_rows") - 1 - F.size(good)).cast("long").alias("dropped"))


def _trimmed_cells(cells: Column) -> Column:
    """The last match of a line is empty, at its end: it is no cell."""
    return F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(1)))


def images_of(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """(stem, annotation, image) of files (path) by their stem; of several images the first kind in order counts, none gives null."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    # Kinds of images in the order in which they are taken.
    rank = F.array_position(F.array(*map(F.lit, ("png", "jpg", "jpeg", "tif", "tiff"))), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    found = images.select(stem.alias("stem"), F.col("path").alias("image"), rank.alias("r")).where("r > 0").groupBy("stem").agg(F.min(F.struct("r", "image")).alias("i"))
    return annotations.select(stem.alias("stem"), F.col("path").alias("annotation")).join(found, "stem", "left").select("stem", "annotation", F.col("i.image").alias("image"))


def main_part(html: Column) -> Column:
    """The first article, else main, else body, else all."""
    part = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), F.lit(""))
    return F.coalesce(part("article"), part("main"), part("body"), html)


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags, in single spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " "), r"(?s)<[^>]+>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(c))
    return strip(collapse(bare))


def page_title(url: Column, html: Column) -> Column:
    """The title, else the path's segments in reverse, else the host."""
    title = F.nullif(html_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    segments = F.filter(F.split(F.parse_url(url, F.lit("PATH")), "/"), lambda s: s != "")
    named = F.array_join(F.reverse(F.transform(segments, lambda s: F.initcap(F.replace(s, F.lit("-"), F.lit(" "))))), " - ")
    return F.coalesce(title, F.nullif(named, F.lit("")), F.concat(F.lit("Web Document from "), F.parse_url(url, F.lit("HOST"))))


def box_line(line: Column) -> Column:
    """The text of 'x1,y1,...,text[,confidence]': eight or four numbers in front go, and a last part from 0 to 1."""
    parts = F.transform(F.split(line, ","), strip)
    number = lambda x: F.trim(x).try_cast("double").isNotNull()
    lead = lambda p, n: (F.size(p) > n) & F.forall(F.slice(p, 1, n), number)
    rest = F.when(lead(parts, 8), F.slice(parts, 9, 100000)).when(lead(parts, 4), F.slice(parts, 5, 100000)).otherwise(parts)
    last = F.trim(F.element_at(rest, -1)).try_cast("double")
    return strip(F.array_join(F.when((F.size(rest) > 1) & F.coalesce(last.between(0, 1), F.lit(False)), F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest), ","))


def box_text(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, r"\r?\n"), box_line), lambda x: x != ""), "\n")


def ocr_text(rows: Column) -> Column:
    """An array of (box, text, score) as lines; only texts with a letter count."""
    return F.array_join(F.filter(F.transform(rows, lambda x: strip(x["text"])), lambda x: x.rlike(r"\p{L}")), "\n")


def form_answers(forms: DataFrame) -> DataFrame:
    """(doc, question, answer): answers linked to questions, whichever way the link points; forms: (doc, form array<struct<id,label,text,linking>>)."""
    items = forms.select("doc", F.explode("form").alias("f")).select("doc", "f.*")
    pairs = items.select("doc", F.explode("linking").alias("l")).select("doc", F.col("l")[0].alias("a"), F.col("l")[1].alias("b"))
    both = pairs.union(pairs.select("doc", "b", "a"))
    q = items.where("label = 'question'").select("doc", F.col("id").alias("a"), F.col("text").alias("question"))
    a = items.where("label = 'answer' and trim(text) != ''").select("doc", F.col("id").alias("b"), F.trim("text").alias("answer"))
    return both.join(q, ["doc", "a"]).join(a, ["doc", "b"]).select("doc", "question", "answer").distinct()
