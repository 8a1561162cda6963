"""Business documents: extraction, queries, search and metrics on small cases."""

import math
import random
import re
from collections import Counter
from functools import reduce

import duckdb
import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import queries
from quillspark.functions import text as T
from quillspark.functions import values as V
from quillspark.operators import metrics as M
from quillspark.operators import search as S
from quillspark.operators.postings import build_postings
from quillspark.operators.ranges import build_ranges
from quillspark.operators.classify import wording_type
from quillspark.operators.extract import AMOUNT, ANY_AMOUNT, covered, fields, nearest_amount
from quillspark.operators.queries import parse_queries
from quillspark.operators.validate import BREAKS, LINES, PLAIN, SPACES, WORDS, bad_supplier, field_checks, text_quality, validate

CASES = [
    ("Invoice No INV-42", "invoice", {"invoice_number": "INV-42"}),
    ("Invoice No 42", "invoice", {"invoice_number": None}),
    ("SALES RECEIPT\nQuantum Logic Solutions\nCash Total 45.50", "receipt", {"supplier": "Quantum Logic Solutions", "amount": "45.50"}),
    ("TOTAL\n$20.00\nCASH TENDERED\n$50.00\nCHANGE\n$30.00", "receipt", {"amount": "$20.00"}),
    ("ORIGINAL\n5380034300\n25.01.2026\nPO Number :\nPO Creation Date :\nPURCHASE ORDER\nSUPPLIER: SCREENLINE (PVT) LTD-1007037\n", "purchase_order", {"invoice_number": "5380034300", "supplier": "SCREENLINE (PVT) LTD"}),
    ("INVOICE # 6817 SuperStore Bill To: Aaron Hawkins\nOct 23 2012\n$10,672.30\nBalance Due\nTotal", "invoice", {"invoice_number": "6817", "date": "Oct 23 2012", "amount": "$10,672.30", "supplier": "SuperStore"}),
    ("", "invoice", {"invoice_number": None, "date": None, "amount": None, "supplier": None}),
    (None, "receipt", {"amount": None}),
]


def test_fields(spark):
    rows = spark.createDataFrame([(i, t, k) for i, (t, k, _) in enumerate(CASES)], "i int, text string, kind string").select("i", fields(F.col("text"), F.col("kind")).alias("f")).collect()
    for r in rows:
        for name, value in CASES[r.i][2].items():
            assert r.f[name] == value, (CASES[r.i][0], name)


@pytest.mark.parametrize("code", ["GST", "TRN", "QTY", "UOM", "FAX", "VAT"])
def test_markers_within_names(spark, code):
    name = f"{code} Trading Company"
    texts = [(f"INVOICE # 18213920\nVendor: {name}\nBill To: A\nInvoice Date: 1997-08-26\nBalance Due: $1,858.52", "invoice"), (f"PURCHASE ORDER\nPO Number : 5388203922\nPO Creation Date : 22.04.1996\nSUPPLIER: {name}\nGrand Total 1,858.52", "purchase_order")]
    df = spark.createDataFrame(texts, "text string, label string").withColumn("fields", fields(covered(F.col("text")), F.col("label")))
    df = df.withColumn("classification", F.struct("label", F.lit(None).cast("double").alias("confidence"), F.lit("heuristic").alias("confidence_source")))
    for r in validate(df).collect():
        assert (r.fields.supplier, r.fields.amount.lstrip("$"), r.validation.pipeline_status) == (name, "1,858.52", "processed")
    # Markers that begin no organisation's name still are markers.
    bare = spark.createDataFrame([(f"Vendor: {code} 12 Company",), (f"{code} Company Name: Acme Stores",)], "text string")
    assert all(r.t == r.text for r in bare.select("text", covered(F.col("text")).alias("t")).collect())


def _marker_orders(spark, folder):
    """Orders of every type and flaw whose suppliers' codes are markers, as the tables that rendered() reads."""
    rows = [(i * 18 + j, sum((ord(x) - 65) * 26**n for n, x in enumerate(code))) for i, code in enumerate(("GST", "TRN", "QTY", "UOM", "FAX", "VAT")) for j in range(18)]
    orders = spark.createDataFrame(rows, "o_orderkey long, sk long")
    orders.selectExpr("o_orderkey", "o_orderkey % 5 AS o_custkey", "1001.91D + o_orderkey AS o_totalprice", "timestamp '1995-01-01' + make_interval(0, 0, 0, cast(o_orderkey as int)) AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    orders.selectExpr("o_orderkey AS l_orderkey", "sk AS l_suppkey").write.parquet(f"{folder}/lineitem.parquet")
    spark.range(5).selectExpr("id AS c_custkey", "'Customer#' || id AS c_name").write.parquet(f"{folder}/customer.parquet")
    return len(rows)


def test_validation_of_markers_within_names(spark, tmp_path):
    n = _marker_orders(spark, tmp_path)
    got = queries.QUERIES["v5_validation"](spark, str(tmp_path)).groupBy("status", "warnings", "score").count().collect()
    assert [tuple(r) for r in got] == [("processed", 0, 1.0, n)]


def test_report_of_flaws_beside_markers_within_names(spark, tmp_path):
    _marker_orders(spark, tmp_path)
    con = duckdb.connect()
    for name in ("orders", "lineitem", "customer"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    wanted = con.sql(queries.ORACLE["v6_flawed_report"]).fetchall()
    got = queries.QUERIES["v6_flawed_report"](spark, str(tmp_path)).select("status", "type", "n").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_pos_within_names(spark):
    asked = ["receipts from POS Trading Company over 12", "purchase orders the pos company over 3", "pos over 3"]
    known = spark.createDataFrame([("POS Trading Company",), ("The POS Company",)], "supplier string")
    got = {r.query: (r.document_type, r.supplier) for r in parse_queries(spark.createDataFrame([(q,) for q in asked], "query string"), known).collect()}
    assert [got[q] for q in asked] == [("receipt", "POS Trading Company"), ("purchase_order", "The POS Company"), ("purchase_order", None)]


def test_amounts_and_dates(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("x")).first().x
    for text, want in (("3000", "3000"), ("3,000", "3000"), ("$1,500.50", "1500.5"), ("LKR 1500", "1500"), ("1.250,00", "1.2500"), ("none", None)):
        got = pick(V.query_amount(F.lit(text)))
        assert (None if got is None else float(got)) == (None if want is None else float(want))
    for text, want in (("1.4.2026", "2026-04-01"), ("1st of January 2026", "2026-01-01"), ("25-Nov-2025", "2025-11-25"), ("31.02.2026", None), ("5/6/85", None)):
        got = pick(V.query_date(F.lit(text)))
        assert (got and str(got)) == want


def test_types(spark):
    rows = spark.createDataFrame([("cash bill", "receipt"), ("Tax Invoice", "invoice"), ("PO-1234 receipt", "purchase_order"), ("hello", None)], "text string, want string")
    assert all(r.got == r.want for r in rows.select("want", wording_type(F.col("text")).alias("got")).collect())


def test_queries(spark):
    asked = ["purchase orders below 3000 office supplies", "after January 2026", "invoice 39519 Aaron Bergman", "between 1000 and 3000", "receipts between 1 January 2026 and 31 January 2026", " "]
    got = {r.query: r for r in parse_queries(spark.createDataFrame([(q,) for q in asked], "query string")).collect()}
    assert (got[asked[0]].document_type, float(got[asked[0]].amount_lt), got[asked[0]].semantic_text) == ("purchase_order", 3000.0, "office supplies")
    assert got[asked[1]].error.startswith("Date filters")
    assert (got[asked[2]].document_number, got[asked[2]].semantic_text) == ("39519", "Aaron Bergman")
    assert (float(got[asked[3]].amount_min), float(got[asked[3]].amount_max)) == (1000.0, 3000.0)
    assert str(got[asked[4]].date_max) == "2026-01-31" and got[asked[4]].amount_min is None
    assert got[asked[5]].error == "query is required"


def test_validation(spark):
    text = "INVOICE # 12345\nVendor: ABC Trading\nInvoice Date: 2026-01-02\nBalance Due: $10.00 and some more words to be long enough here"
    df = spark.createDataFrame([(text,), (None,)], "text string")
    df = df.withColumn("classification", F.struct(F.lit("invoice").alias("label"), F.lit(None).cast("double").alias("confidence"), F.lit("heuristic").alias("confidence_source"))).withColumn("fields", fields(F.col("text"), F.lit("invoice")))
    got = [r.validation for r in validate(df).collect()]
    assert got[0].pipeline_status == "processed" and got[0].validation_score == 1.0
    assert got[1].pipeline_status == "needs_review" and got[1].critical_warning_count == 1


def test_ranking(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 11, 3), (1, 10, 1), (2, 99, 2)], "query_id int, doc_id int, grade int")
    got = {(r.query_id, r.k): r for r in M.ranking_metrics(hits, qrels, (1, 3)).collect()}
    assert got[1, 1].precision == 1.0 and got[1, 1].recall == 0.5 and got[1, 3].rr == 1.0 and got[2, 3].ndcg == 0.0
    assert got[1, 3].ndcg == pytest.approx((1 + 7 / 1.5849625) / (7 + 1 / 1.5849625))


def test_dense_top_k_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_VECTORS", 30)
    rows = [(i, [math.sin(i * j % 97) for j in range(1, 9)]) for i in range(200)] + [(1000 + i, [0.5] * 8) for i in range(100)] + [(5000, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = [r for r in rows if r[0] % 7 == 0 and r[1]]
    found = S.dense_top_k(v.where("vec_id % 7 = 0").selectExpr("vec_id query_id", "embedding query_vector"), v, 4)
    # One product of many rows, not one of every pair in a nested loop.
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    held = {r.vec_id: list(r.embedding) for r in v.where("embedding is not null").collect()}
    for i, _ in asked:
        all_of = sorted((-round(sum(x * y for x, y in zip(held[i], e, strict=True)), 6), j) for j, e in held.items())
        assert [got[i][n] for n in range(1, 5)] == [(j, -s) for s, j in all_of[:4]]


def test_hashed_vectors(spark, tmp_path):
    texts = ["Red invoice red total 42", "blue INVOICE", None, "", "the ... -", "total total zebra", "é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [[x for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in T.STOP_WORDS for x in [w, *T.SYNONYMS.get(w, [])]] for t in texts]
    df, want = Counter(w for ws in words for w in set(ws)), {}
    for i, ws in enumerate(words):
        sums = Counter()
        for w in ws:
            h = 0
            for c in w:
                h = (h * 131 + ord(c)) % 256
            sums[h] += math.log((1 + len(texts)) / (1 + df[w])) + 1
        norm = math.sqrt(sum(x * x for x in sums.values()))
        want |= {(i, h): x / norm for h, x in sums.items()} or {(i, None): 0.0}
    got = queries.QUERIES["q14_hashed_vectors"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.doc_id, r.bucket): r.weight for r in got} == pytest.approx(want)


def _search_brute(asked, docs, k):
    """Phrase tiers, gate, bounds, share of words and rank, one pair at a time."""
    norm = lambda x: re.sub(r"\s+", " ", re.sub(r"[^\w\s]|_", " ", (x or "").lower())).strip()
    rows = []
    for q in asked:
        if q["error"]:
            continue
        phrase, scored, gate = norm(q["semantic_text"]), [], False
        for d in docs:
            fields = [norm(d["number"]), norm(d["supplier"]), "", norm(d["text"])]
            inside = [i + 1 for i, f in enumerate(fields) if phrase and (f == phrase if i == 0 else f" {phrase} " in f" {f} ")]
            gate = gate or bool(inside)
            ok = q["document_type"] in (None, d["type"]) and (q["supplier"] is None or norm(q["supplier"]) == norm(d["supplier"]))
            ok = ok and (q["document_number"] is None or q["document_number"].lower() in d["number"])
            ok = ok and (q["amount_lt"] is None or (d["amount"] is not None and d["amount"] < q["amount_lt"]))
            if ok:
                words, have = set(phrase.split()), set((fields[1] + " " + fields[3]).split())
                scored.append((inside[0] if inside else 5, len(words & have) / len(words) if words else 0.0, d["doc_id"]))
        if q["semantic_text"] == "":
            best = [(None, 1.0, i) for _, _, i in sorted(scored, key=lambda x: x[2])]
        else:
            best = sorted((x for x in scored if not gate or x[0] < 5), key=lambda x: (x[0], -x[1], x[2]))
        rows += [(q["query_id"], r + 1, i, round(s, 9), t) for r, (t, s, i) in enumerate(best[:k])]
    return sorted(rows, key=str)


@pytest.mark.parametrize("block", [10_000, 2])
def test_search(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(S, "MAX_QUERIES", block)
    docs = [
        ("1", "invoice", "Alpha Ltd", "inv-10", 100.0, "alpha ltd chairs and tables"),
        ("2", "receipt", "Beta Co", "r-7", 50.0, "beta co tables"),
        ("3", "invoice", "Alpha Ltd", "inv-11", None, "green chairs"),
        ("4", "purchase_order", "", "", 900.0, ""),
        ("5", None, None, "x", 20.0, "lamps for alpha"),
        ("6", "receipt", "Beta Co", "r-8", 10.0, "beta co lamps and chairs"),
    ]
    docs = [dict(zip(("doc_id", "type", "supplier", "number", "amount", "text"), r, strict=True)) for r in docs]
    corpus = spark.createDataFrame(docs, "doc_id string, type string, supplier string, number string, amount double, text string")
    n = lambda c: T.normal_name(F.coalesce(F.col(c), F.lit("")))
    corpus = corpus.select("doc_id", F.col("doc_id").alias("doc_ord"), "type", "supplier", n("supplier").alias("supplier_norm"), "number", n("number").alias("number_norm"), F.col("amount").cast("decimal(18,4)").alias("amount_dec"), F.lit(None).cast("date").alias("date_val"), F.lit("").alias("filename_norm"), n("text").alias("text_norm"))
    none = {"document_type": None, "supplier": None, "document_number": None, "amount_lt": None, "semantic_text": "", "error": None}
    cases = [
        {}, {"document_type": "invoice"}, {"supplier": "ALPHA, ltd"}, {"supplier": "Beta Co", "document_type": "invoice"}, {"amount_lt": 60.0},
        {"document_number": "INV"}, {"semantic_text": "green chairs"}, {"semantic_text": "beta co", "amount_lt": 20.0}, {"semantic_text": "r 7"},
        {"semantic_text": "chairs lamps"}, {"semantic_text": "green chairs", "document_type": "receipt"}, {"semantic_text": "zebra", "document_type": "receipt"},
        {"semantic_text": "red lamps", "supplier": "Beta Co"}, {"semantic_text": "!!"}, {"error": "query is required"}, {"semantic_text": "nothing here", "amount_lt": 30.0},
    ]
    asked = [{"query_id": i, **none, **c} for i, c in enumerate(cases)]
    q = spark.createDataFrame(asked, "query_id long, document_type string, supplier string, document_number string, amount_lt double, semantic_text string, error string")
    ops = ("eq", "lt", "lte", "gt", "gte", "min", "max")
    q = q.withColumn("amount_lt", F.col("amount_lt").cast("decimal(18,4)")).withColumns({f"amount_{x}": F.lit(None).cast("decimal(18,4)") for x in ops if x != "lt"} | {f"date_{x}": F.lit(None).cast("date") for x in ops})
    got = [(r.query_id, r.rank, r.doc_id, round(r.score, 9), r.lexical_tier) for r in S.search(q, corpus, 4).collect()]
    assert sorted(got, key=str) == _search_brute(asked, docs, 4)
    if block > 2:  # through the stored indexes
        ordered = corpus.withColumn("doc_ord", F.col("doc_ord").cast("long"))
        ranges, postings = build_ranges(ordered, f"{tmp_path}/ranges", k=4, bins=4), build_postings(ordered, f"{tmp_path}/postings")
        for held in ({"ranges": ranges}, {"postings": postings}, {"ranges": ranges, "postings": postings}):
            got = [(r.query_id, r.rank, r.doc_id, round(r.score, 9), r.lexical_tier) for r in S.search(q, ordered, 4, **held).collect()]
            assert sorted(got, key=str) == _search_brute(asked, docs, 4), held
    assert S.search(q.where("false"), corpus).count() == 0
    scores = spark.createDataFrame([(11, "2", 0.9), (11, "6", 0.1), (9, "5", 0.8)], "query_id long, doc_id string, score double")
    by = {(r.query_id, r.doc_id): r.score for r in S.search(q, corpus, 9, scores, 0.5).collect()}
    assert {k for k in by if k[0] == 11} == {(11, "2"), (11, "6")} and {k for k in by if k[0] == 9} == {(9, "5")}


def test_tokens_are_dealt_by_document_once(spark):
    docs = spark.createDataFrame([(1, "oak desk oak"), (2, "desk and the lamp"), (3, "of the"), (3, "lamp")], "doc_id long, text string")
    made = S.hashed_vectors(docs, S.idf(docs))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


def test_lines_and_words_of_odd_texts(spark):
    texts = ["", " \n\t", "a\x1c\x1cb\n\n c--d '- e-", "--a-b'--\r\n \r\n x\x85é́ _ ٤", "\x1e \x1d!\n''\n-"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    bare = T.strip(F.col("text"))
    lines = F.size(F.filter(F.split(bare, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"), lambda x: T.strip(x) != ""))
    got = df.select(text_quality(F.col("text")).alias("q"), lines.cast("long").alias("lines"), F.regexp_count(bare, F.lit(r"(?U)\b[\w'-]+\b")).cast("long").alias("words"))
    rows = got.select("q.line_count", "lines", "q.word_count", "words").collect()
    assert [(r[0], r[2]) for r in rows] == [(r[1], r[3]) for r in rows]


def test_text_quality_measures_once(spark):
    plan = spark.range(1).select(text_quality(F.col("id").cast("string")).alias("q")).select("q.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 5


def _plan(column) -> str:
    return column._jdf.queryExecution().optimizedPlan().toString()


def test_fields_read_a_type_once_and_amounts_as_asked(spark):
    df = spark.createDataFrame([("x", "invoice")], "text string, kind string")
    plan = _plan(df.select(fields(F.col("text"), F.lower(F.col("kind"))).alias("f")))
    assert plan.count("lower(kind") <= 2
    # A receipt's nearest amount comes first, an invoice's labelled one: the labels of each are looked for in one place.
    assert plan.count("balance\\s+paid|amount\\s+paid|paid\\s+amount|total)\\b)(?=(") == 1 and plan.count("(?=((?:balance\\s+due)\\b)?)") == 1


def test_amounts_are_found_as_by_the_plain_pattern(spark):
    rng = random.Random(3)
    parts = ["rs", "Rs.", "RM", "LKR", "lkr", "$", " ", "\n", "\t", "1", "12", "123", "1234", ",", ",123", ".", ".5", ".50", ".123", "x", "é", "٤", "K", "-"]
    df = spark.createDataFrame([("".join(rng.choices(parts, k=rng.randint(0, 12))),) for _ in range(4000)], "text string")
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    assert df.where(found(ANY_AMOUNT) != found("(?i)" + AMOUNT)).count() == 0 and df.where(F.size(found(ANY_AMOUNT)) > 0).count() > 500


def test_nearest_amount_of_the_first_label(spark):
    cases = [
        ("Grand Total qty 5.00\n" + "x " * 40 + "\nTotal 7.00", "7.00"),  # the first label's only amount is noise
        ("8.00 Total abcd 9.00", "9.00"),  # of the same distance the larger
        ("9.00 Total abcd 8.00", "9.00"),
        ("9.00 Total 8.00", "8.00"),
        ("Total 3.00\nGrand Total 2.00", "2.00"),  # an earlier label wins, wherever it stands
        ("Total rs1.00 and 45.00", "45.00"),  # what is no number is passed over
        ("Total", None),
    ]
    rows = spark.createDataFrame(cases, "text string, want string").select("want", nearest_amount(F.col("text"), ("grand\\s+total", "total")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_checks_are_made_once(spark):
    df = spark.createDataFrame([("x", "invoice")], "text string, kind string")
    row = F.struct(*[F.col("text").alias(n) for n in ("invoice_number", "date", "amount", "supplier")])
    plan = _plan(df.select(field_checks(F.col("kind"), row).alias("c")))
    assert plan.count("document number looks invalid") == 1 and plan.count("supplier is missing") == 1


def test_classes_with_ascii_first_hold_the_same(spark):
    chars = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000] + ["﷐", "\U0001f600", "\U00010400", "\U0001d7d8"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    plain = {
        LINES: rf"[^{SPACES}{BREAKS}][^{BREAKS}]*+",
        WORDS: r"(?U)[0-9A-Za-z_\w][0-9A-Za-z_'\-\w]*+",
        PLAIN: r"[\p{L}\p{N}.,:/#\-&()$%+]+",
    }
    cut = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    texts = [F.col("c"), F.concat(F.lit("a"), F.col("c"), F.lit("b"))]
    assert df.where(reduce(Column.__or__, [cut(t, new) != cut(t, old) for t in texts for new, old in plain.items()])).count() == 0
    bad = {"supplier": "the Bill To: x", "ok": "Acme Stores"}
    names = spark.createDataFrame([(v,) for v in bad.values()], "name string").select(bad_supplier(F.col("name")).alias("b")).collect()
    assert [r.b for r in names] == [True, False]
