"""Registered queries over the given tables, and the same in DuckDB's SQL."""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import values as V
from .operators import metrics as M
from .operators import search as S
from .operators import store as D
from .operators import training as G
from .operators import validate as C
from .operators import vectors as X
from .operators.classify import wording_type
from .operators.exports import query_level, write_query_level
from .operators.ordering import in_order, page_of
from .operators.postings import build_postings
from .operators.queries import parse_queries
from .operators.ranges import build_ranges, first_within
from .plans.corpus import SQL as CORPUS
from .plans.corpus import VARIED, flawed, read, rendered, varied
from .plans.process import process
from .sources import files as R
from .sources.shared import shared_path, written

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _docs(spark, d):
    return read(spark, d, "documents")


@query("p1_clean_text", r"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5 from documents""")
def p1(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean_md5"))


@query("p3_names", r"""select s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[[:punct:]]', ' ', 'g'), '\s+', ' ', 'g')) AS name_norm, regexp_replace(trim(lower(s_name)), '[[:punct:]]', '', 'g') AS name_cmp from supplier""")
def p3(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", T.normal_name(F.col("s_name")).alias("name_norm"), T.comparable(F.col("s_name")).alias("name_cmp"))


@query("p5_loose_match", r"""with n as (select p_partkey, regexp_replace(lower(p_name), '[[:punct:]]', '', 'g') a, regexp_replace(lower(p_type), '[[:punct:]]', '', 'g') b from part) select p_partkey, (a <> '' and b <> '' and (contains(a, b) or contains(b, a))) AS alike from n""")
def p5(spark, d):
    return read(spark, d, "part").select("p_partkey", T.alike(F.col("p_name"), F.col("p_type")).alias("alike"))


@query("p13_preview_counts", r"""select doc_id, md5(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 1000)) AS preview_md5, cast(len(regexp_extract_all(text, '[^ \t\n\r]+')) as bigint) AS words, cast(length(text) as bigint) AS chars, cast(floor(length(text) / 4) as bigint) AS doc_tokens, cast(case when length(text) = 0 then 0 else greatest(1, floor(length(text) / 4)) end as bigint) AS chunk_tokens from documents""")
def p13(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.md5(T.preview(t)).alias("preview_md5"), T.word_count(t).alias("words"), F.length(t).cast("long").alias("chars"), T.document_tokens(t).alias("doc_tokens"), T.chunk_tokens(t).alias("chunk_tokens"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_SYN = "map {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in T.SYNONYMS.items()) + "}"
_TOKENS = f"flatten(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w not in ({_STOPS})), lambda w: list_concat([w], coalesce({_SYN}[w], cast([] as varchar[])))))"


@query("p21_tokens", f"select doc_id, cast(len(t) as bigint) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 from (select doc_id, {_TOKENS} t from documents)")
def p21(spark, d):
    rows = _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query("p22_token_buckets", f"""with w as (select distinct unnest({_TOKENS}) tok from documents), b as (select tok, list_reduce(list_concat([0], list_transform(string_split(tok, ''), lambda c: ascii(c))), lambda h, c: (h * 131 + c) % 256) bucket from w) select cast(bucket as bigint) AS bucket, count(*) AS n from b group by bucket""")
def p22(spark, d):
    w = _docs(spark, d).select(F.explode(T.tokens(F.col("text"))).alias("tok")).distinct()
    return w.groupBy(T.token_bucket(F.col("tok")).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


_CORPUS = f"with {CORPUS} "


@query("p6_amounts", _CORPUS + """select doc_id, cast(replace(format('{:,.2f}', gold_total), ',', '') as decimal(18,4)) AS amount, cast(replace(format('{:,.2f}', gold_total), ',', '') as double) AS shown from corpus""")
def p6(spark, d):
    c = rendered(spark, d).select("doc_id", F.concat(F.lit("Rs. "), F.format_number("gold_total", 2)).alias("a"))
    return c.select("doc_id", V.query_amount(F.regexp_replace("a", "^Rs\\.", "")).alias("amount"), V.display_amount(F.col("a")).alias("shown"))


@query("p8_dates", _CORPUS + "select doc_id, gold_date AS iso, gold_date AS dmy, gold_date AS worded, true AS plausible, true AS checked from corpus")
def p8(spark, d):
    g = lambda f: F.date_format("gold_date", f)
    worded = F.concat(g("d"), F.lit("th of "), g("MMMM"), F.lit(", "), g("yyyy"))
    return rendered(spark, d).select("doc_id", V.query_date(g("yyyy-MM-dd")).alias("iso"), V.query_date(g("dd.MM.yy")).alias("dmy"), V.query_date(worded).alias("worded"), V.plausible_date(g("dd-MMM-yyyy")).alias("plausible"), V.checked_date(g("MM/dd/yyyy")).alias("checked"))


_FORMS = ("yyyy/MM/dd", "d/M/yyyy", "dd-MM-yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMMM d, yyyy", "dd/MM/yy", "d.M.yyyy", "yyyy.MM.dd", "MMM d yyyy")


@query("p8_date_forms", _CORPUS + "select doc_id, " + ", ".join(f"gold_date AS form_{i}" for i in range(len(_FORMS))) + " from corpus")
def p8_forms(spark, d):
    """The order date in ten forms."""
    return rendered(spark, d).select("doc_id", *[V.query_date(F.date_format("gold_date", f)).alias(f"form_{i}") for i, f in enumerate(_FORMS)])


@query("p9_dates_judged", _CORPUS + "select doc_id, [true, true, true, true, true, true, true, false, false, false][1 + (doc_id // 3) % 10] AS plausible, [true, false, false, false, true, true, true, false, false, false][1 + (doc_id // 3) % 10] AS checked from corpus")
def p9(spark, d):
    """Dates in forms that both checks take, that only the first takes, and that neither does."""
    day = lambda f: F.date_format("gold_date", f)
    forms = F.array(*map(day, ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "d MMMM yyyy", "MMMM d, yyyy", "dd.MM.yyyy", "MM/dd/yyyy")), F.concat(F.lit("45/"), day("dd/yyyy")), F.concat(day("dd/MM/"), F.lit("1899")), F.concat(day("yyyy-MM-dd"), F.lit(" at noon")))
    text = F.get(forms, F.pmod(F.floor(F.col("doc_id") / 3), F.lit(10)).cast("int"))
    return rendered(spark, d).select("doc_id", V.plausible_date(text).alias("plausible"), V.checked_date(text).alias("checked"))


@query("p11_value_checks", "select o_orderkey AS doc_id, [true, true, true, true, false, false, false, false][1 + o_orderkey % 8] AS good_amount, [false, false, true, true, false, true, false, true][1 + o_orderkey % 8] AS bad_number from orders")
def p11(spark, d):
    """Amounts and numbers that the field checks take and refuse."""
    key = F.pmod("o_orderkey", F.lit(8)).cast("int")
    amount, n = F.format_number("o_totalprice", 2), F.col("o_orderkey").cast("string")
    pick = lambda *values: F.get(F.array(*values), key)
    money = pick(amount, F.concat(F.lit("Rs. "), amount), F.concat(F.lit("$"), amount), F.concat(F.lit(" lkr "), n), F.concat(amount, F.lit(" USD")), F.concat(F.lit("EUR "), n), F.concat(n, F.lit(".125")), F.lit("free"))
    number = pick(F.concat(F.lit("INV"), n), F.concat(F.lit("10-"), n), F.lit("none"), F.lit("7"), F.concat(F.lit(" A1"), n), F.lit("#INV"), F.concat(n, F.lit("/2026")), F.lit(" 7 "))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), V.checked_amount(money).alias("good_amount"), V.bad_number(number).alias("bad_number"))


@query("p16_wording_type", _CORPUS + "select gold_type, gold_type AS type, count(*) AS n from corpus group by gold_type")
def p16(spark, d):
    return rendered(spark, d).groupBy("gold_type", wording_type(F.col("text")).alias("type")).agg(F.count("*").alias("n"))


@query("e_fields", _CORPUS + """select doc_id, case gold_type when 'invoice' then cast(doc_id + 10000 as varchar) when 'receipt' then 'R' || cast(doc_id + 10000 as varchar) else cast(doc_id + 5380000000 as varchar) end AS invoice_number,
 case gold_type when 'invoice' then strftime(gold_date, '%Y-%m-%d') when 'receipt' then strftime(gold_date, '%d/%m/%Y') else strftime(gold_date, '%d.%m.%Y') end AS date,
 case gold_type when 'invoice' then '$' when 'receipt' then 'Rs. ' else '' end || format('{:,.2f}', gold_total) AS amount, gold_supplier AS supplier from corpus""")
def e_fields(spark, d):
    return process(rendered(spark, d).select("doc_id", "text")).select("doc_id", "fields.*")


@query("e_varied_fields", _CORPUS + ", " + VARIED)
def e_varied(spark, d):
    """Every branch of the extraction over eight wordings a type."""
    found = process(varied(rendered(spark, d)))
    return found.select("doc_id", "form", F.col("classification.label").alias("type"), "fields.*")


@query("v1_text_quality", r"""with x as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) t from documents), y as (select *, regexp_replace(t, '\s', '', 'g') s from x), z as (select *, greatest(length(s), 1) b, length(regexp_replace(s, '[^0-9]', '', 'g')) dg, length(regexp_replace(s, '[^\p{Lu}]', '', 'g')) up, length(regexp_replace(s, '[\p{L}\p{N}.,:/#\-&()$%+]', '', 'g')) sy from y)
select doc_id, cast(length(t) as bigint) AS char_count, cast(len(list_filter(string_split(t, chr(10)), lambda l: trim(l) <> '')) as bigint) AS line_count, round(dg / b, 4) AS digit_ratio, round(sy / b, 4) AS symbol_noise_ratio, round(up / b, 4) AS uppercase_ratio from z""")
def v1(spark, d):
    return _docs(spark, d).select("doc_id", C.text_quality(F.col("text")).alias("q")).select("doc_id", *[f"q.{c}" for c in ("char_count", "line_count", "digit_ratio", "symbol_noise_ratio", "uppercase_ratio")])


@query("v5_validation", _CORPUS + "select doc_id, 'processed' AS status, cast(0 as bigint) AS warnings, 1.0::double AS score from corpus")
def v5(spark, d):
    v = F.col("validation")
    return process(rendered(spark, d).select("doc_id", "text")).select("doc_id", v["pipeline_status"].alias("status"), v["total_warnings"].alias("warnings"), v["validation_score"].alias("score"))


@query("v6_status_report", _CORPUS + "select 'processed' AS status, gold_type AS type, count(*) AS n from corpus group by gold_type")
def v6(spark, d):
    return C.status_report(process(rendered(spark, d).select("doc_id", "text")))


# An invoice without its supplier: 'Balance Due: $950.10' is taken for a name as long as digits are less than 0.35 of its letters and digits.
_FLAWS = """f as (select *, (doc_id // 3) % 6 flaw from corpus), x as (select doc_id, flaw, case flaw when 1 then 'date is missing.' when 2 then 'amount is missing.'
 when 3 then case when gold_type = 'invoice' and gold_total < 1000 then '' else 'supplier is missing.' end
 when 4 then case gold_type when 'invoice' then 'invoice number is missing.' when 'purchase_order' then 'purchase order number is missing.' else '' end
 when 5 then 'date has an unsupported format: ' || case gold_type when 'invoice' then strftime(gold_date, '%Y/%m/%d') else strftime(gold_date, '%d-%m-%Y') end else '' end says from f)"""


@query("v3_flawed_documents", _CORPUS + f", {_FLAWS} select doc_id, flaw, says AS warnings, case when flaw = 5 then 'needs_review' when says <> '' then 'processed_with_warnings' else 'processed' end AS status, cast(case when flaw = 5 then 1 else 0 end as bigint) AS critical, case when flaw = 5 then 0.67::double when says <> '' then 0.92::double else 1.0::double end AS score from x")
def v3(spark, d):
    v = F.col("validation")
    checked = process(flawed(rendered(spark, d).select("doc_id", "text")))
    return checked.select("doc_id", "flaw", F.array_join(v["warnings"], "; ").alias("warnings"), v["pipeline_status"].alias("status"), v["critical_warning_count"].alias("critical"), v["validation_score"].alias("score"))


@query("v6_flawed_report", _CORPUS + f", {_FLAWS} select case when x.flaw = 5 then 'needs_review' when says <> '' then 'processed_with_warnings' else 'processed' end AS status, gold_type AS type, count(*) AS n from x join corpus using (doc_id) group by all")
def v6_flawed(spark, d):
    return C.status_report(process(flawed(rendered(spark, d).select("doc_id", "text"))))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """A query for every 20th order: its type below its own total, from its own date on."""
    c = rendered(spark, d).where("doc_id % 20 = 0")
    words = F.replace(F.col("gold_type"), F.lit("_"), F.lit(" "))
    text = F.concat(words, F.lit("s under "), F.floor(F.col("gold_total") / 50).cast("string"), F.lit(" on or after "), F.date_format("gold_date", "yyyy-MM-dd"))
    return c.select(F.col("doc_id").alias("query_id"), text.alias("query"), F.lit(False).alias("expects_no_results"))


_ASKED = "q as (select doc_id query_id, gold_type t, cast(floor(gold_total / 50) as decimal(18,4)) a, gold_date d from corpus where doc_id % 20 = 0)"


@query("q1_parse_queries", _CORPUS + f", {_ASKED} select query_id, t AS document_type, a AS amount_lt, d AS date_gte, '' AS semantic_text from q")
def q1(spark, d):
    return parse_queries(asked(spark, d)).select("query_id", "document_type", "amount_lt", "date_gte", "semantic_text")


def worded(spark: SparkSession, d: str) -> DataFrame:
    """A query for every order, in eight wordings: dates, ranges, amounts, suppliers, numbers, an incomplete date, a blank."""
    c = rendered(spark, d)
    kinds, n, day = F.concat(F.replace(F.col("gold_type"), F.lit("_"), F.lit(" ")), F.lit("s ")), F.floor(F.col("gold_total") / 50), lambda f: F.date_format("gold_date", f)
    forms = [
        F.concat(kinds, F.lit("on or before "), day("d MMMM yyyy")),
        F.concat(kinds, F.lit("between "), n, F.lit(" and "), n + 100),
        F.concat(kinds, F.lit("at least "), n),
        F.concat(kinds, F.lit("from "), F.col("gold_supplier"), F.lit(" over "), n),
        F.concat(kinds, F.lit("dated "), day("yyyy-MM-dd")),
        F.concat(F.replace(F.col("gold_type"), F.lit("_"), F.lit(" ")), F.lit(" "), F.col("doc_id") + 10000, F.lit(" oak desk")),
        F.concat(kinds, F.lit("after "), day("yyyy")),
        F.lit("  "),
    ]
    return c.select(F.col("doc_id").alias("query_id"), F.get(F.array(*forms), (F.floor(F.col("doc_id") / 3) % 8).cast("int")).alias("query"))


@query("q1_query_wordings", _CORPUS + """, q as (select *, (doc_id // 3) % 8 w, cast(floor(gold_total / 50) as decimal(18,4)) n from corpus)
select doc_id AS query_id, case when w <> 7 then gold_type end AS document_type, case when w = 5 and gold_type <> 'purchase_order' then cast(doc_id + 10000 as varchar) end AS document_number,
 case when w = 3 then gold_supplier end AS supplier, case when w = 0 then gold_date end AS date_lte, case when w = 4 then gold_date end AS date_eq,
 case when w = 2 then n end AS amount_gte, case when w = 3 then n end AS amount_gt, case when w = 1 then n end AS amount_min, case when w = 1 then cast(n + 100 as decimal(18,4)) end AS amount_max,
 case w when 5 then case when gold_type = 'purchase_order' then cast(doc_id + 10000 as varchar) || ' ' else '' end || 'oak desk' when 6 then 'after ' || year(gold_date) else '' end AS semantic_text,
 case w when 6 then 'Date filters require a complete day, month, and year, for example: after 1st January 2026.' when 7 then 'query is required' end AS error from q""")
def q1_wordings(spark, d):
    return parse_queries(worded(spark, d)).select("query_id", "document_type", "document_number", "supplier", "date_lte", "date_eq", "amount_gte", "amount_gt", "amount_min", "amount_max", "semantic_text", "error")


@query("q1_shared_words", _CORPUS + """, n as (select *, split_part(gold_supplier, ' ', 1) w from corpus) select doc_id AS query_id, gold_type AS document_type, case doc_id % 4 when 0 then 'The ' || w || ' Company' when 1 then 'The ' || w when 2 then 'The Company' end AS supplier, cast(doc_id % 500 as decimal(18,4)) AS amount_gt, case when doc_id % 4 = 3 then 'the zebra ' || lower(w) || ' firm ' else '' end || 'paper' AS semantic_text from n""")
def q1_shared(spark, d):
    """Queries of all orders for names that begin and end with the same words: 'The <code> Company', 'The <code>', 'The Company'."""
    c = rendered(spark, d).withColumn("w", F.split("gold_supplier", " ")[0])
    code, the = F.col("w"), F.lit("The ")
    names = c.select(F.explode(F.array(F.concat(the, code, F.lit(" Company")), F.concat(the, code), F.lit("The Company"))).alias("supplier"))
    name = F.get(F.array(F.concat(F.lit("the "), code, F.lit(" company")), F.concat(F.lit("the "), code), F.lit("the company"), F.concat(F.lit("the zebra "), code, F.lit(" firm"))), F.pmod("doc_id", F.lit(4)).cast("int"))
    asked = c.select(F.col("doc_id").alias("query_id"), F.concat(F.replace("gold_type", F.lit("_"), F.lit(" ")), F.lit("s "), F.lower(name), F.lit(" over "), F.pmod("doc_id", F.lit(500)).cast("string"), F.lit(" paper")).alias("query"))
    return parse_queries(asked, names).select("query_id", "document_type", "supplier", "amount_gt", "semantic_text")


@query("q3_structured_search", _CORPUS + f", {_ASKED}, m as (select query_id, doc_id, row_number() over (partition by query_id order by doc_id) r from q join corpus on gold_type = t and cast(replace(format('{{:,.2f}}', gold_total), ',', '') as decimal(18,4)) < a and gold_date >= d) select query_id, cast(r as integer) AS rank, doc_id, 1.0::double AS score from m where r <= 5")
def q3(spark, d):
    corpus = written(S.search_corpus(process(rendered(spark, d).select("doc_id", "text"))), "search-corpus")
    index = build_ranges(corpus, shared_path(spark, "range-index"))
    return S.search(written(parse_queries(asked(spark, d)), "queries"), corpus, ranges=index).select("query_id", "rank", "doc_id", "score")


@query("q3_range_cells", _CORPUS + """, q as (select doc_id query_id, (doc_id // 3) % 4 w, case when (doc_id // 3) % 5 > 0 then gold_type end t, cast(replace(format('{:,.2f}', gold_total), ',', '') as decimal(18,4)) a, gold_date d from corpus where doc_id % 20 = 0),
 m as (select query_id, c.doc_id, row_number() over (partition by query_id order by c.doc_id) r from q join (select doc_id, gold_type, cast(replace(format('{:,.2f}', gold_total), ',', '') as decimal(18,4)) x, gold_date y from corpus) c on (t is null or gold_type = t) and case w when 0 then x between a and a * 1.01 when 1 then y between d and d + 20 when 2 then x > a and y < d else x <= a and y > d end)
select query_id, doc_id from m where r <= 5""")
def q3_range_cells(spark, d):
    """Narrow and wide ranges of amounts and dates, with and without a type, over the rendered orders' own values."""
    c = rendered(spark, d)
    held = written(c.select("doc_id", F.col("doc_id").alias("doc_ord"), F.col("gold_type").alias("type"), V.query_amount(F.format_number("gold_total", 2)).alias("amount_dec"), F.col("gold_date").alias("date_val")), "range-corpus")
    w, amount, day = F.floor(F.col("doc_id") / 3) % 4, F.col("amount_dec"), F.col("date_val")
    of = lambda n, value, kind: F.when(w == n, value).cast(kind)
    money = "decimal(18,4)"
    bounds = {
        "amount_min": of(0, amount, money), "amount_max": of(0, F.floor(amount * F.lit("1.01").cast("decimal(3,2)") * 10000) / 10000, money),
        "date_min": of(1, day, "date"), "date_max": of(1, F.date_add(day, 20), "date"), "amount_gt": of(2, amount, money), "date_lt": of(2, day, "date"),
        "amount_lte": of(3, amount, money), "date_gt": of(3, day, "date"),
    }
    bounds |= {n: F.lit(None).cast(kind) for kind, names in ((money, ("amount_eq", "amount_lt", "amount_gte")), ("date", ("date_eq", "date_lte", "date_gte"))) for n in names}
    asked = held.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.when(F.floor(F.col("doc_id") / 3) % 5 > 0, F.col("type")).alias("document_type"), *[v.alias(n) for n, v in bounds.items()])
    return first_within(build_ranges(held, shared_path(spark, "range-index")), asked, 5).select("query_id", "doc_id")


@query("q6_phrase_search", _CORPUS + """, q as (select distinct gold_supplier n, gold_supplier query_id from corpus), m as (select query_id, doc_id, row_number() over (partition by query_id order by doc_id) r from q join corpus on gold_supplier = n where gold_type = 'receipt') select query_id, cast(r as integer) AS rank, doc_id, cast(2 as integer) AS lexical_tier from m where r <= 5""")
def q6(spark, d):
    c = rendered(spark, d)
    q = c.select(F.col("gold_supplier").alias("query_id")).distinct().select("query_id", F.concat(F.lit("receipts "), F.col("query_id")).alias("query"))
    corpus = written(S.search_corpus(process(c.select("doc_id", "text"))), "search-corpus")
    postings = build_postings(corpus, shared_path(spark, "postings"))
    return S.search(written(parse_queries(q), "queries"), corpus, postings=postings).select("query_id", "rank", "doc_id", "lexical_tier")


@query("q11_word_search", _CORPUS + """, c as (select *, lower(split_part(gold_supplier, ' ', 1)) w from corpus), q as (select doc_id query_id, gold_type t, w from c where doc_id % 20 = 0),
 s as (select query_id, doc_id, case when c.w = q.w then 2 else 1 end / 3 score from q join c on gold_type = t), m as (select *, row_number() over (partition by query_id order by score desc, doc_id) r from s)
 select query_id, cast(r as integer) AS rank, doc_id, score, cast(5 as integer) AS lexical_tier from m where r <= 5""")
def q11_words(spark, d):
    """Three words for every 20th order: one that all documents hold, one that none does, and the first of its supplier."""
    c = rendered(spark, d)
    words = F.concat(F.replace(F.col("gold_type"), F.lit("_"), F.lit(" ")), F.lit("s company zebra "), F.split("gold_supplier", " ")[0])
    q = c.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), words.alias("query"))
    corpus = written(S.search_corpus(process(c.select("doc_id", "text"))), "search-corpus")
    held = {"ranges": build_ranges(corpus, shared_path(spark, "range-index"), k=10), "postings": build_postings(corpus, shared_path(spark, "postings"))}
    return S.search(written(parse_queries(q), "queries"), corpus, **held)


_TOP = "t as (select a.vec_id query_id, b.vec_id, a.label = b.label same, b.label bl, a.label al, round(list_inner_product(cast(b.embedding as double[]), cast(a.embedding as double[])), 6) score from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from t)"


def nearest(spark, d, k=5):
    v = read(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    top = S.dense_top_k(q, v.select("vec_id", "embedding"), k + 1).where("query_id != vec_id")
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)


@query("q8_dense_top_k", f"with {_TOP} select query_id, cast(rank as integer) AS rank, vec_id, score from r where rank <= 5")
def q8(spark, d):
    return nearest(spark, d).select("query_id", "rank", "vec_id", "score")


def _vector_index(spark, d):
    """An index of all embeddings, and every 20th as a query."""
    v = read(spark, d, "embeddings")
    index = X.build_index(v, shared_path(spark, "vector-index"), 64)
    return index, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _others(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits other than the query's own vector."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.where("query_id != vec_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@query("q12_vector_index", "select vec_id, cast(len(embedding) as bigint) AS dimension, true AS within from embeddings")
def q12(spark, d):
    index, _ = _vector_index(spark, d)
    away = F.sqrt(F.aggregate(F.zip_with("vector", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    held = index.vectors().join(F.broadcast(spark.read.parquet(f"{index.folder}/lists")), "list")
    return held.select("vec_id", F.size("vector").cast("long").alias("dimension"), (away <= F.col("radius")).alias("within"))


@query("q8_index_exact", f"with {_TOP} select query_id, cast(rank as integer) AS rank, vec_id, score from r where rank <= 5")
def q8_index(spark, d):
    index, queries = _vector_index(spark, d)
    return _others(X.search_index(index, queries, k=6, exact=True), 5).select("query_id", "rank", "vec_id", "score")


@query("q8_index_recall", "select count(*) AS queries, true AS at_least_nine_tenths from embeddings where vec_id % 20 = 0")
def q8_recall(spark, d):
    index, queries = _vector_index(spark, d)
    found = _others(X.search_index(index, queries, k=6, probes=X.probes_for(index, queries, k=6)), 5)
    each = X.recall_of(found, nearest(spark, d))
    return each.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("at_least_nine_tenths"))


@query("a22_idf", f"with w as (select distinct doc_id, unnest({_TOKENS}) token from documents), n as (select count(*) n from documents) select token, count(*) AS df, round(ln((1 + any_value(n)) / (1 + count(*))) + 1, 6) AS idf from w, n group by token")
def a22(spark, d):
    return S.idf(_docs(spark, d)).select("token", "df", F.round("idf", 6).alias("idf"))


@query("q14_hashed_vectors")
def q14(spark, d):
    docs = _docs(spark, d).select("doc_id", "text")
    return S.hashed_vectors(docs, S.idf(docs))


def _graded(spark, d):
    """Hits of a query's own label, and how many other vectors have that label."""
    v = read(spark, d, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    found = nearest(spark, d).join(q, "query_id").join(v, ["vec_id", "label"]).select("query_id", "rank", F.lit(1).alias("grade"))
    sizes = v.groupBy("label").agg(F.count("*").alias("n"))
    return found, q.join(sizes, "label").select("query_id", F.lit(1).alias("grade"), (F.col("n") - 1).alias("n"))


@query("w1_ranking_metrics", f"""with {_TOP}, rel as (select query_id, count(*) n from t where same group by query_id), k as (select unnest([1, 3, 5]) k), g as (select query_id, k, count(*) filter (where same) f, min(rank) filter (where same) first, sum(case when same then 1 / log2(rank + 1) else 0 end) dcg from r, k where rank <= k group by query_id, k), i as (select query_id, k, (select sum(1 / log2(x + 1)) from unnest(range(1, cast(least(n, k) as bigint) + 1)) u(x)) ideal, n from rel, k)
select cast(k as integer) AS k, count(*) AS queries, round(avg(f / k), 6) AS precision, round(avg(f / n), 6) AS recall, round(avg(coalesce(1 / first, 0)), 6) AS rr, round(avg(dcg / ideal), 6) AS ndcg from g join i using (query_id, k) group by k""")
def w1(spark, d):
    return M.mean_metrics(M.graded_metrics(*_graded(spark, d)))


_GRADED = f"with {_TOP}, rel as (select a.vec_id query_id, b.vec_id, 1 + b.vec_id % 3 g from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and a.label = b.label and a.label < 9), ks as (select unnest([1, 3, 5]) k), qs as (select vec_id query_id, label from embeddings where vec_id % 20 = 0), hit as (select r.query_id, r.rank, r.vec_id, r.score, rel.g from r left join rel using (query_id, vec_id) where r.rank <= 5), n as (select query_id, count(*) n from rel group by query_id), ideal as (select query_id, k, sum((2 ** g - 1) / log2(i + 1)) ideal from (select *, row_number() over (partition by query_id order by g desc) i from rel), ks where i <= k group by query_id, k), m as (select query_id, k, count(g) / k p, coalesce(count(g) / any_value(n), 0) r, coalesce(1 / min(case when g is not null then rank end), 0) rr, coalesce(sum(case when g is not null then (2 ** g - 1) / log2(rank + 1) end) / any_value(ideal), 0) nd from hit left join n using (query_id) cross join ks left join ideal using (query_id, k) where rank <= k group by query_id, k)"


def _graded_search(spark, d):
    """Every 20th vector as a query; vectors of its label are relevant, with grades 1 to 3, but for the last label, which has none."""
    v = read(spark, d, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label")
    queries = q.select("query_id", F.concat(F.lit('like "'), F.col("query_id").cast("string"), F.lit('", near')).alias("query_text"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("category"), (F.col("label") == 9).alias("expects_no_results"))
    qrels = q.where("label < 9").join(v, "label").where("query_id != vec_id").select("query_id", F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 3 + 1).cast("int").alias("grade"))
    hits = written(nearest(spark, d).select("query_id", "rank", F.col("vec_id").alias("doc_id"), "score", F.lit(None).cast("int").alias("lexical_tier")), "hits")
    return queries, qrels, hits


@query("s22_query_level", _GRADED + """, w as (select query_id, max(case when k = 1 then p end) p1, max(case when k = 1 then r end) r1, max(case when k = 1 then rr end) rr1, max(case when k = 1 then nd end) n1, max(case when k = 3 then p end) p3, max(case when k = 3 then r end) r3, max(case when k = 3 then rr end) rr3, max(case when k = 3 then nd end) n3, max(case when k = 5 then p end) p5, max(case when k = 5 then r end) r5, max(case when k = 5 then rr end) rr5, max(case when k = 5 then nd end) n5 from m group by query_id),
 h as (select query_id, string_agg(vec_id, ', ' order by rank) ids, count(*) c, min(case when g is not null then rank end) f, min_by(vec_id, rank) tid, min_by(score, rank) ts from hit group by query_id), e as (select query_id, string_agg(vec_id || ':' || g, ', ' order by vec_id) docs, count(*) c from rel group by query_id)
select query_id, 'like "' || query_id || '", near' AS query_text, 'label ' || label AS category, case when label = 9 then 'True' else 'False' end AS expects_no_results, coalesce(docs, '<none>') AS gold_relevant_docs, coalesce(e.c, 0) AS gold_relevant_count, ids AS retrieved_doc_ids, h.c AS retrieved_count,
 format('{:.4f}', p1) AS p_at_1, format('{:.4f}', r1) AS r_at_1, format('{:.4f}', rr1) AS rr_at_1, format('{:.4f}', n1) AS ndcg_at_1, format('{:.4f}', p3) AS p_at_3, format('{:.4f}', r3) AS r_at_3, format('{:.4f}', rr3) AS rr_at_3, format('{:.4f}', n3) AS ndcg_at_3, format('{:.4f}', p5) AS p_at_5, format('{:.4f}', r5) AS r_at_5, format('{:.4f}', rr5) AS rr_at_5, format('{:.4f}', n5) AS ndcg_at_5,
 coalesce(cast(f as varchar), '') AS first_relevant_rank, cast(tid as varchar) AS top_1_doc_id, format('{:.4f}', ts) AS top_1_score, '' AS top_1_lexical_tier, case when label = 9 then 'FAIL' else 'N/A' end AS no_match_status from qs join h using (query_id) join w using (query_id) left join e using (query_id)""")
def s22(spark, d):
    """The export written as CSV and read back."""
    path = shared_path(spark, "query-level")
    rows = query_level(*_graded_search(spark, d))
    write_query_level(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path).fillna("")


@query("a11_by_category", _GRADED + " select 'label ' || label AS category, cast(k as integer) AS k, count(*) AS queries, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(rr), 6) AS rr, round(avg(nd), 6) AS ndcg from m join qs using (query_id) where label < 9 group by all")
def a11(spark, d):
    queries, qrels, hits = _graded_search(spark, d)
    per = M.ranking_metrics(hits.select("query_id", "doc_id", "rank"), qrels).join(queries.select("query_id", "category"), "query_id")
    return M.mean_metrics(per, ["category"]).select("category", "k", "queries", "precision", "recall", "rr", "ndcg")


_JUDGED = "j as (select quality gold, case when length(text) >= 600 then 1 else 0 end pred, lang, case when quality = case when length(text) >= 600 then 1 else 0 end then 1 else 0 end ok from documents join labels using (doc_id))"


def _judged(spark, d):
    pred = F.when(F.length("text") >= 600, 1).otherwise(0)
    return _docs(spark, d).join(read(spark, d, "labels"), "doc_id").select(F.col("quality").alias("gold"), pred.alias("pred"), "lang", (F.col("quality") == pred).alias("correct"))


@query("a2_class_metrics", f"with {_JUDGED}, c as (select unnest([0, 1]) class), s as (select class, count(*) filter (where gold = class and pred = class) tp, count(*) filter (where gold <> class and pred = class) fp, count(*) filter (where gold = class and pred <> class) fn, count(*) filter (where gold = class) support from j, c group by class), m as (select *, coalesce(tp / nullif(tp + fp, 0), 0) p, coalesce(tp / nullif(tp + fn, 0), 0) r from s) select class, tp, fp, fn, support, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 from m")
def a2(spark, d):
    return M.class_metrics(_judged(spark, d))


@query("a5_confusion", f"""with {_JUDGED} select cast(gold as varchar) AS gold, count(*) filter (where pred = 0) AS "0", count(*) filter (where pred = 1) AS "1", cast(0 as bigint) AS "EXTRACTION_FAILED", count(*) AS total from j group by gold""")
def a5(spark, d):
    return M.confusion(_judged(spark, d), [0, 1])


@query("a6_slices", f"with {_JUDGED} select 'lang' AS slice, lang AS value, count(*) AS n, round(avg(ok), 4) AS accuracy from j group by lang union all select 'gold', cast(gold as varchar), count(*), round(avg(ok), 4) from j group by gold")
def a6(spark, d):
    return M.slice_accuracy(_judged(spark, d), ["lang", "gold"])


@query("a13_distribution", "select event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, round(quantile_disc(value, 0.75) - quantile_disc(value, 0.25), 6) AS iqr from events where value is not null group by event_type")
def a13(spark, d):
    return M.distribution(read(spark, d, "events"), "value", ["event_type"])


@query("a14_balanced_means", "with p as (select event_type, user_id, avg(value) m, sum(value) s, count(value) c from events where value is not null group by all) select event_type, count(*) AS documents, round(avg(m), 6) AS balanced_mean, round(median(m), 6) AS balanced_median, round(sum(s) / sum(c), 6) AS run_mean from p group by event_type")
def a14(spark, d):
    return M.balanced_mean(read(spark, d, "events"), "value", "user_id", ["event_type"])


@query("a15_stage_shares", "with m as (select event_type, avg(value) m from events group by event_type) select event_type, round(m, 6) AS mean, round(100 * m / sum(m) over (), 4) AS share, m = max(m) over () AS dominant from m")
def a15(spark, d):
    return M.stage_shares(read(spark, d, "events"), "event_type", "value")


def _stored(spark, d):
    t = _docs(spark, d)
    return t.select("doc_id", F.pmod("doc_id", F.lit(7)).alias("user_id"), F.sha2("text", 256).alias("file_hash"), F.concat(F.lit("invoice-"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".pdf")).alias("filename"), F.timestamp_seconds(F.col("doc_id") % 1000).alias("created_at"))


@query("j6_new_documents", "select user_id, count(*) AS n, min(doc_id) AS first from (select doc_id % 7 user_id, sha256(text) h, min(doc_id) doc_id from documents group by all) where true group by user_id".replace("sha256(text) h, min(doc_id) doc_id from documents group by all", "sha256(text) h, min(doc_id) doc_id from documents group by doc_id % 7, sha256(text)"))
def j6(spark, d):
    return D.new_documents(_stored(spark, d)).groupBy("user_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("w6_page", "select doc_id from documents order by doc_id % 1000 desc, doc_id desc limit 20 offset 20")
def w6(spark, d):
    return D.page(_stored(spark, d), 2, 20).select("doc_id")


@query("w8_deep_page", """with r as (select c_custkey, case when c_custkey % 9 > 0 then c_nationkey end k from customer), n as (select *, row_number() over (order by k desc nulls last, c_custkey desc) i, count(*) over () n from r)
select c_custkey, k AS nation from n where (i - 1) // 40 = (n // 2) // 40""")
def w8(spark, d):
    """The page in the middle of all customers, by nation, some without one; only its cells are read."""
    rows = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 > 0, F.col("c_nationkey")).alias("nation"))
    kept = in_order(rows, F.col("nation").desc_nulls_last(), F.col("c_custkey").desc(), cell_rows=1000)
    return page_of(kept, kept.rows // 2 // 40 + 1, 40)


@query("s4_json_lists", r"""select c_custkey, case c_custkey % 4 when 0 then 'Item 1: ' || c_name || chr(10) || 'Item 2: ' || c_nationkey || chr(10) || 'Item 3: None' when 1 then 'name: ' || c_name || chr(10) || 'key: ' || c_custkey when 2 then c_name else '' end AS text from customer""")
def s4_lists(spark, d):
    """Lists, objects, bare strings and empty lists made of each customer's columns."""
    text, key = F.col("c_name"), F.pmod("c_custkey", F.lit(4))
    made = F.when(key == 0, F.concat(F.lit('["'), text, F.lit('", '), F.col("c_nationkey").cast("string"), F.lit(", null]"))).when(key == 1, F.to_json(F.struct(text.alias("name"), F.col("c_custkey").alias("key")))).when(key == 2, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.lit("[]"))
    return read(spark, d, "customer").select("c_custkey", R.json_text(made).alias("text"))


@query("w7_named", "select doc_id % 7 AS user_id, count(*) AS n from documents where contains('invoice-' || lpad(cast(doc_id as varchar), 7, '0') || '.pdf', '12') group by 1")
def w7(spark, d):
    return D.named_like(_stored(spark, d), "12").groupBy("user_id").agg(F.count("*").alias("n"))


@query("w9_recent", "select doc_id % 7 AS user_id, doc_id, cast(row_number() over (partition by doc_id % 7 order by doc_id % 1000 desc, doc_id desc) as integer) AS rank from documents qualify rank <= 5")
def w9(spark, d):
    return D.recent(_stored(spark, d)).select("user_id", "doc_id", "rank")


@query("s4_json_text", r"""select event_id, array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || json_extract_string(props, '$."' || k || '"')), chr(10)) AS text from events""")
def s4(spark, d):
    return read(spark, d, "events").select("event_id", R.json_text(F.col("props")).alias("text"))


_BARE = r"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({}, '(?is)<script\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))".replace('\\"', '"')


@query("s6_html_text", f"select page_id, md5({_BARE.format('html')}) AS text_md5 from pages")
def s6(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(R.html_text(F.col("html"))).alias("text_md5"))


@query("s7_main_part", r"select page_id, md5(coalesce(nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1), ''), nullif(regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1), ''), nullif(regexp_extract(html, '(?is)<body\b[^>]*>(.*?)</body>', 1), ''), html)) AS part_md5 from pages")
def s7(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(R.main_part(F.col("html"))).alias("part_md5"))


@query("s17_digests", "select doc_id, sha256(text) AS digest from documents")
def s17(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("g1_chunks", "with c as (select doc_id, text, unnest(range(0, cast(greatest(length(text) - 101, 0) + 1 as bigint), 900)) s from documents where length(text) > 0) select doc_id, count(*) AS chunks, cast(sum(least(s + 1000, length(text)) - s) as bigint) AS chars, md5(string_agg(substr(text, s + 1, 1000), '|' order by s)) AS content_md5 from c group by doc_id")
def g1(spark, d):
    c = G.chunks(_docs(spark, d))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "|")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"), F.md5(whole).alias("content_md5"))


@query("g3_approved", "select source, count(*) AS n from documents where doc_id in (select doc_id from labels where quality = 1) group by source")
def g3(spark, d):
    return G.approved(_docs(spark, d), read(spark, d, "labels")).groupBy("source").agg(F.count("*").alias("n"))


@query("g5_splits", "select case when b < 8 then 'train' when b = 8 then 'validation' else 'test' end AS split, count(*) AS n from (select cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 4)) as bigint) % 10 b from documents) group by 1")
def g5(spark, d):
    return _docs(spark, d).groupBy(G.split_of(F.col("doc_id")).alias("split")).agg(F.count("*").alias("n"))


def _examples(spark, d):
    return rendered(spark, d).select("doc_id", "text", F.col("gold_type").alias("label"), G.split_of(F.col("doc_id")).alias("split"))


# The three classes' wordings differ, so a sound classifier tells all test documents right.
@query("m1_text_classifier", _CORPUS + "select gold_type AS class, count(*) AS tp, cast(0 as bigint) AS fp, cast(0 as bigint) AS fn, count(*) AS support, 1.0::double AS precision, 1.0::double AS recall, 1.0::double AS f1 from corpus where cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 4)) as bigint) % 10 = 9 group by gold_type")
def m1(spark, d):
    c = written(_examples(spark, d), "examples")
    model = G.text_classifier(c.where("split = 'train'").select("text", "label"))
    return M.class_metrics(G.predicted(model, c.where("split = 'test'")).select(F.col("label").alias("gold"), F.col("model_label").alias("pred")))


@query("m6_top_features", _CORPUS + "select gold_type AS class, cast(10 as bigint) AS features, true AS in_its_documents from corpus group by gold_type")
def m6(spark, d):
    """The ten features of largest weight by class, named: each with a weight above 0 stands in documents of its class."""
    c = written(_examples(spark, d), "examples")
    top = G.top_features(G.text_classifier(c.where("split = 'train'").select("text", "label"), features=4096, named=True)).collect()  # ten a class
    words = c.select(F.col("label").alias("class"), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"\b\w\w+\b"), F.lit(0)), " ").alias("words"))

    def held(r):
        """Whether a document of the feature's class has all its words."""
        if r.weight <= 0:
            return F.max(F.lit(True))
        return F.max(F.when(F.col("class") == r["class"], reduce(and_, [F.col("words").contains(w) for w in r.feature.split(" ")])))

    found = words.agg(*[held(r).alias(f"held{i}") for i, r in enumerate(top)])
    seen = found.select(F.inline(F.array(*[F.struct(F.lit(r["class"]).alias("class"), F.col(f"held{i}").alias("held")) for i, r in enumerate(top)])))
    return seen.groupBy("class").agg(F.count("*").alias("features"), F.min(F.coalesce("held", F.lit(True))).alias("in_its_documents"))


@query("a20_statistics", "select source, lang, count(*) AS n, cast(sum(n_chars) as bigint) AS chars from documents group by grouping sets ((source), (lang), ())")
def a20(spark, d):
    return _docs(spark, d).groupingSets([["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").cast("long").alias("chars")).select("source", "lang", "n", "chars")


from . import evaluation as _evaluation  # noqa: E402, F401  (registers its queries)
