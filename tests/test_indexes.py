"""Stored indexes against plain searches."""

import csv
import glob
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import exports as X
from quillspark.operators import metrics as M
from quillspark.operators import ordering as O
from quillspark.operators import postings as P
from quillspark.operators import quantiles as Q
from quillspark.operators import ranges as R
from quillspark.operators import search as S
from quillspark.operators import training as G
from quillspark.operators import vectors as V
from quillspark.operators.queries import known_names, parse_queries
from quillspark.queries import QUERIES
from quillspark.sources.files import csv_lines

# vectors


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def _plain(rows, queries, k):
    out = {}
    ids, m = np.array([i for i, v in rows if v is not None]), np.array([v for _, v in rows if v is not None], np.float64)
    for i, q in queries:
        s = np.round(m @ np.array(q, np.float64), 6) + 0.0
        out[i] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:k]]
    return out


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[min(i % 12, 7)] + r.normal(size=6) / 3]) for i in range(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)] + [(5000, None)]  # a third of all in one place
    return rows, V.build_index(_vectors(spark, rows), str(tmp_path_factory.mktemp("index") / "a"), 6, lists=12)


def test_index_holds_every_vector(spark, clustered):
    rows, index = clustered
    held = index.vectors().select("vec_id", "vector").collect()
    assert sorted((r.vec_id, list(r.vector)) for r in held) == sorted(x for x in rows if x[1] is not None)
    again = V.open_index(spark, index.folder)
    assert (again.centres == index.centres).all() and len(index.numbers) <= 12 and (index.cells >= 1).all()
    for n, c, radius in zip(index.numbers, index.centres, index.radii, strict=True):
        m = np.array([list(r.vector) for r in index.vectors().where(F.col("list") == int(n)).collect()])
        assert np.linalg.norm(m - c, axis=1).max() <= radius + 1e-9


def test_index_search(spark, clustered, monkeypatch):
    rows, index = clustered
    monkeypatch.setattr(V, "CELL_ROWS", 40)  # lists in several cells, queries in several blocks
    asked = [(i, v) for i, v in rows if v is not None and i % 7 == 0]
    queries = spark.createDataFrame([*asked, (9999, None)], "query_id long, query_vector array<float>")
    want = _plain(rows, asked, 5)
    got = {}
    for r in V.search_index(index, queries, probes=1, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    assert got.keys() == want.keys()
    for i in want:
        assert [a for a, _ in got[i]] == [a for a, _ in want[i]] and np.allclose([s for _, s in got[i]], [s for _, s in want[i]], atol=2e-6)
    probes = V.probes_for(index, queries, recall=0.95)
    recall = V.recall_of(V.search_index(index, queries, probes=probes), spark.createDataFrame([(q, v) for q, x in want.items() for v, _ in x], "query_id long, vec_id long"))
    assert probes < len(index.numbers) and recall.agg(F.avg("recall")).first()[0] >= 0.9


def test_index_in_cells(spark, clustered, tmp_path, monkeypatch):
    rows, _ = clustered
    monkeypatch.setattr(V, "CELL_ROWS", 50)
    index = V.build_index(_vectors(spark, rows), f"{tmp_path}/b", 6, lists=4, sample=100)
    assert index.cells.max() > 3 and index.vectors().groupBy("list", "cell").count().agg(F.max("count")).first()[0] < 130
    exact = V.search_index(index, spark.createDataFrame([(1, rows[5][1])], "query_id long, query_vector array<float>"), k=4, probes=2, exact=True).collect()
    assert [r.vec_id for r in sorted(exact, key=lambda r: r["rank"])] == [i for i, _ in _plain(rows, [(1, rows[5][1])], 4)[1]]


def test_index_of_nothing(spark, tmp_path):
    index = V.build_index(_vectors(spark, []), f"{tmp_path}/none", 6)
    queries = spark.createDataFrame([(1, [0.0] * 6)], "query_id long, query_vector array<float>")
    assert V.search_index(index, queries, exact=True).count() == 0 and V.probes_for(index, queries) == 0
    with pytest.raises(Exception, match="dimension is not 5"):
        V.build_index(_vectors(spark, [(1, [0.0] * 6)]), f"{tmp_path}/bad", 5)


# order statistics


@pytest.mark.parametrize("few", [3, 50, 10_000])
def test_quantiles(spark, few):
    r = random.Random(5)
    rows = [("hot", 7.0)] * 700 + [("hot", r.gauss(0, 1e3)) for _ in range(400)] + [("one", 2.5)] + [(None, float(i % 5)) for i in range(60)]
    rows += [("wide", x) for x in (-1.7e308, -1.0, 0.0, 1e-300, 2e-300, 1.0, 1.7e308)] + [("low", None), ("low", float("nan"))] + [("pow", 2.0**-i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {q.g: q for q in Q.quantiles(df, "x", ["g"], {"d90": 0.9, "d0": 0.0, "d100": 1.0, "d25": 0.25}, {"c50": 0.5, "c33": 0.33}, few).collect()}
    groups = {}
    for g, x in rows:
        if x is not None and x == x:
            groups.setdefault(g, []).append(x)
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        xs = sorted(xs)
        at = lambda p: xs[max(1, -(-round(p * 100) * len(xs) // 100)) - 1]  # noqa: B023, E731
        assert (got[g].d90, got[g].d0, got[g].d100, got[g].d25) == (at(0.9), xs[0], xs[-1], at(0.25)), g
        assert got[g].c50 == pytest.approx(float(np.quantile(xs, 0.5))) and got[g].c33 == pytest.approx(float(np.quantile(xs, 0.33)))
    whole = Q.quantiles(df, "x", [], {"m": 0.5}, few=few).collect()
    every = sorted(x for xs in groups.values() for x in xs)
    assert [w.m for w in whole] == [every[-(-len(every) // 2) - 1]] and Q.quantiles(df.where("g = 'low'"), "x", ["g"], {"m": 0.5}).count() == 0


def test_summaries_by_order_statistics(spark):
    df = spark.createDataFrame([("a", float(i % 17)) for i in range(100)] + [(None, 1.0), (None, 4.0)], "g string, x double")
    got = {r.g: r for r in M.distribution(df, "x", ["g"]).collect()}
    want = {r.g: r for r in df.groupBy("g").agg(F.expr("percentile_disc(0.9) within group (order by x)").alias("p90"), F.round(F.median("x"), 6).alias("median")).collect()}
    assert {g: (r.p90, r.median) for g, r in got.items()} == {g: (r.p90, r.median) for g, r in want.items()} and got[None].n == 2


# ranges


def _range_rows(seed, n):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        amount = None if r.random() < 0.1 else 500.0 if r.random() < 0.3 else round(r.uniform(0, 1000), r.randrange(5))
        day = None if r.random() < 0.1 else r.randrange(19000, 19400)
        docs.append((i, r.randrange(n) if i % 3 else 7, r.choice(["invoice", "receipt", None, "receipt"]), amount, day))
    asked = []
    for i in range(220):
        b = {f"{w}_{op}": None for w in ("amount", "date") for op in R._OPS}
        for w, pick in (("amount", lambda: r.choice([500.0, round(r.uniform(-50, 1100), 2)])), ("date", lambda: r.randrange(18990, 19410))):
            for op in r.sample(R._OPS, r.choice([0, 1, 1, 2])):
                b[f"{w}_{op}"] = pick()
        asked.append((i, r.choice(["invoice", "receipt", None, "order"]), b))
    return docs, asked


_TESTS = {"eq": lambda v, b: v == b, "lt": lambda v, b: v < b, "lte": lambda v, b: v <= b, "gt": lambda v, b: v > b, "gte": lambda v, b: v >= b, "min": lambda v, b: v >= b, "max": lambda v, b: v <= b}


@pytest.mark.parametrize("n,bins,k", [(0, 32, 5), (3, 4, 5), (1500, 8, 3), (1500, 32, 5)])
def test_first_within(spark, tmp_path, n, bins, k):
    docs, asked = _range_rows(n + bins, n)
    df = spark.createDataFrame(docs, "doc_id long, doc_ord long, type string, a double, d int")
    corpus = df.select("doc_id", "doc_ord", "type", F.col("a").cast("decimal(18,4)").alias("amount_dec"), F.date_from_unix_date("d").alias("date_val"))
    names = [f"{w}_{op}" for w in ("amount", "date") for op in R._OPS]
    q = spark.createDataFrame([(i, t, *[b[c] for c in names]) for i, t, b in asked], "query_id long, document_type string, " + ", ".join(f"{c} {'double' if c[0] == 'a' else 'int'}" for c in names))
    q = q.select("query_id", "document_type", *[F.col(c).cast("decimal(18,4)").alias(c) if c[0] == "a" else F.date_from_unix_date(c).alias(c) for c in names])
    index = R.build_ranges(corpus, f"{tmp_path}/r", k=5, bins=bins)
    got = {}
    for r in R.first_within(index, q, k).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    for i, t, b in asked:
        ok = [(o, x) for x, o, kind, a, d in docs if (t is None or kind == t) and all(v is None or (b_of is not None and _TESTS[c.split("_")[1]](b_of, v)) for c, v in b.items() for b_of in [a if c[0] == "a" else d])]
        assert got.get(i, set()) == {x for _, x in sorted(ok)[:k]}, (i, t, b)
    with pytest.raises(ValueError):
        R.first_within(index, q, 6)


@pytest.mark.parametrize("n,bins,k", [(1500, 8, 3), (1500, 4, 5)])
def test_first_within_in_rounds(spark, tmp_path, monkeypatch, n, bins, k):
    monkeypatch.setattr(R, "CHUNK_ROWS", 150)  # several chunks and blocks of queries, all rounds
    assert len(R._rounds(13, 1500)) == 4
    test_first_within(spark, tmp_path, n, bins, k)


def test_equal_bounds_are_searched_once(spark, tmp_path, monkeypatch):
    docs, _ = _range_rows(5, 400)
    df = spark.createDataFrame(docs, "doc_id long, doc_ord long, type string, a double, d int")
    index = R.build_ranges(df.select("doc_id", "doc_ord", "type", F.col("a").cast("decimal(18,4)").alias("amount_dec"), F.date_from_unix_date("d").alias("date_val")), f"{tmp_path}/o", k=5, bins=4)
    seen, searched = [], R._searched
    monkeypatch.setattr(R, "_searched", lambda q, *rest: seen.append(q.count()) or searched(q, *rest))
    names = [f"{w}_{op}" for w in ("amount", "date") for op in R._OPS]
    amounts = sorted(a for *_, a, _ in docs if a is not None)
    q = spark.range(1000).select(F.col("id").alias("query_id"), F.lit(docs[0][2]).alias("document_type"), *[(F.lit(amounts[3] if c == "amount_gt" else None)).cast("decimal(18,4)" if c[0] == "a" else "date").alias(c) for c in names])
    assert R.first_within(index, q, 5).groupBy("query_id").count().count() in (0, 1000) and set(seen) <= {1} and seen


def test_a_node_keeps_k_documents(spark, tmp_path):
    docs, _ = _range_rows(1, 3000)
    df = spark.createDataFrame(docs, "doc_id long, doc_ord long, type string, a double, d int")
    index = R.build_ranges(df.select("doc_id", "doc_ord", "type", F.col("a").cast("decimal(18,4)").alias("amount_dec"), F.date_from_unix_date("d").alias("date_val")), f"{tmp_path}/n", k=2, bins=4)
    assert index.nodes().groupBy("type", "na", "nd").count().agg(F.max("count")).first()[0] == 2 and index.nodes().count() <= 4 * 8 * 8 * 2
    assert index.documents().count() == 3000 and len(index.amounts) <= 4


# postings


@pytest.fixture(scope="module")
def worded(spark, tmp_path_factory):
    r = random.Random(8)
    rare = [f"w{i}" for i in range(200)]
    docs = [(i, r.choice(["", "inv 7", "inv 7 b"]), r.choice(["acme co", "the acme co", ""]), "", " ".join(["the"] * r.randrange(2) + [r.choice(["co", "the", "of", *r.sample(rare, 3)]) for _ in range(r.randrange(14))])) for i in range(700)]
    corpus = spark.createDataFrame([*docs, (900, None, None, None, None)], "doc_id long, number_norm string, supplier_norm string, filename_norm string, text_norm string")
    return docs, P.build_postings(corpus, str(tmp_path_factory.mktemp("postings") / "p"))


def test_postings_hold_every_word(worded):
    docs, index = worded
    want = {}
    for i, *fields in docs:
        for f, text in enumerate(fields, 1):
            words = text.split()
            for p, w in enumerate(words):
                want.setdefault((w, f, i, len(words)), []).append(p)
    assert {(r.term, r.field, r.doc_id, r.length): list(r.positions) for r in index.postings().collect()} == want
    df = {}
    for w, _, i, _ in want:
        df.setdefault(w, set()).add(i)
    assert {r.term: r.df for r in index.terms().collect()} == {w: len(x) for w, x in df.items()}


def test_phrases_by_positions(spark, worded):
    docs, index = worded
    phrases = ["the", "the acme co", "acme", "co the", "inv 7", "7", "w1", "of of", "the the", "nowhere", "the nowhere", "", "w3 the", "co co the", None]
    phrases += [" ".join(d[4].split()[1:4]) for d in docs[::40]]
    got = P.phrase_tiers(index, spark.createDataFrame(list(enumerate(phrases)), "query_id long, phrase string")).collect()
    want = set()
    for q, phrase in enumerate(phrases):
        for i, *fields in docs:
            tiers = [f for f, text in enumerate(fields, 1) if phrase and (text == phrase if f == 1 else f" {phrase} " in f" {text} ")]
            want |= {(q, i, tiers[0])} if tiers else set()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 500


def test_frequent_words_are_not_expanded(spark, worded):
    docs, index = worded
    queries = spark.createDataFrame([(1, ["the", "co", "w5", "nowhere"]), (2, ["the", "co"]), (3, ["w5"]), (4, ["w7"])], "query_id long, ws array<string>")
    got = P.beyond(index, queries, spark.createDataFrame([(1, 2), (2, 2), (3, 0)], "query_id long, c int")).collect()
    has = {i for i, *fields in docs if "w5" in " ".join(fields[1:]).split()}
    assert {(r.query_id, r.doc_id) for r in got} == {(q, i) for q in (1, 3) for i in has}


# order


def test_alike_queries_are_searched_once(spark):
    asked = spark.range(24).selectExpr("id AS query_id", "concat('company zebra ', element_at(array('ax', 'bx', 'cx'), cast(id % 3 as int) + 1)) AS semantic_text", "if(id % 2 = 0, 'invoice', null) AS document_type", "cast(null as string) AS supplier", "cast(null as string) AS document_number", "cast(null as string) AS error")
    first, members = S._once(S._prepared(asked))
    assert sorted(r.query_id for r in first.collect()) == [0, 1, 2, 3, 4, 5]
    assert {(r.query_id, r._first) for r in members.collect()} == {(i, i % 6) for i in range(24)}
    assert sorted(map(str, first.select("phrase", "ws", "document_type").collect())) == sorted(map(str, S._prepared(asked.where("query_id < 6")).select("phrase", "ws", "document_type").collect()))


def test_numbers_and_pages(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "a", "a", "b", str(r.randrange(90))])) for i in range(400)] + [(7, "a")] * 50
    df = spark.createDataFrame(rows, "id long, k string")
    want = sorted(rows, key=lambda x: (x[1] is None, [-ord(c) for c in x[1] or ""] + [0], -x[0]))
    kept = O.in_order(df, F.col("k").desc_nulls_last(), F.col("id").desc(), cell_rows=60)
    assert kept.cells().count() > 3
    got = {x.row: (x.id, x.k) for x in O.numbered_rows(kept).collect()}
    assert [got[i + 1] for i in range(len(rows))] == want
    for number, size in ((1, 7), (30, 7), (2, 300), (999, 50), (0, 1), (5, 100)):
        last = max(1, -(-len(want) // size))
        at = (min(max(number, 1), last) - 1) * size
        assert [tuple(x) for x in O.page_of(kept, number, size).collect()] == want[at : at + size]
    none = O.in_order(df.limit(0), F.col("id"))
    assert O.page_of(none, 3, 5).count() == 0 and O.numbered_rows(none).count() == 0
    with pytest.raises(ValueError):
        O.page_of(kept, 1, 0)


def test_lines_of_rows_without_an_order_value(spark):
    df = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a"), (2, "c")], "o int, v string")
    got = sorted((x.row, x.text) for x in csv_lines(df, ["v"], "o").collect())
    assert got[:2] == [(1, "Row 1: v: n"), (2, "Row 2: v: a")] and {t[-1] for _, t in got[2:]} == {"b", "c"} and len(got) == 4


# suppliers


def test_longest_known_supplier(spark):
    names = ["The Company", "The ABC Company", "ABC", "the abc", "Zed & Sons", "Company", "", None, "the"]
    asked = ["invoices from the abc company", "the-ABC, receipts", "zed sons", "a company", "abcd", "the thing", "", None, "from The Company of ABC"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {r.query_id: r.supplier for r in parse_queries(q, spark.createDataFrame([(n,) for n in names], "supplier string")).collect()}
    assert got == {0: "The ABC Company", 1: "the abc", 2: "Zed & Sons", 3: "Company", 4: None, 5: "the", 6: None, 7: None, 8: "The Company"}
    many = spark.createDataFrame([(f"The {i} Company",) for i in range(50)], "supplier string")
    assert {r._w for r in known_names(many).collect()} == {str(i) for i in range(50)}


# texts


@pytest.mark.parametrize("size,overlap,context", [(10, 3, 4), (7, 0, 7), (8, 4, 2)])
def test_chunks_and_their_contexts(spark, size, overlap, context):
    texts = [None, "", "a", "abcdefghij", "0123456789" * 4, "é😀日\n" * 9, "x" * 17]
    got = {}
    for r in G.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), size, overlap, context=context).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.start, r.end, r.content, r.token_count, r.preceding, r.following))
    step = size - overlap
    for i, t in enumerate(texts):
        starts = range(0, max(len(t) - overlap - 1, 0) + 1, step) if t else ()
        want = [(j, a, min(a + size, len(t)), t[a : a + size], max(1, (min(a + size, len(t)) - a) // 4), t[max(a - context, 0) : a], t[a + size : a + size + context]) for j, a in enumerate(starts)]
        assert sorted(got.get(i, [])) == want, t
    with pytest.raises(ValueError):
        G.chunks(spark.createDataFrame([(1, "a")], "doc_id int, text string"), 5, 4)


def test_named_features(spark):
    rows = spark.createDataFrame([("red apple sweet", "fruit"), ("green apple sour", "fruit"), ("fast car engine", "car"), ("slow car engine", "car")] * 5, "text string, label string")
    model = G.text_classifier(rows, features=50, named=True)
    names = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    assert names[:4] == ["apple", "car", "car engine", "engine"] and "apple sweet" in names
    weights = model.stages[-1].coefficientMatrix.toArray()
    labels = model.stages[0].labels
    for r in G.top_features(model, n=4).collect():
        row = weights[labels.index(r["class"])] if len(weights) > 1 else weights[0]
        assert r.weight == row[names.index(r.feature)] and sum(abs(w) > abs(r.weight) for w in row) < r["rank"]
    said = G.predicted(model, spark.createDataFrame([("an apple",), ("my engine",)], "text string")).collect()
    assert [r.model_label for r in said] == ["fruit", "car"]
    assert G.vocabulary(spark.createDataFrame([(["b", "a", "a"],), (["b"],), (None,)], "terms array<string>"), 5) == ["b", "a"]


def test_text_classifier_cuts_texts_once(spark):
    rows, read = [("an apple is sweet", "fruit"), ("the sweet apple", "fruit"), ("my car engine", "car"), ("car engine oil", "car"), ("no label", None)] * 3, spark.sparkContext.accumulator(0)

    def marked(text):
        read.add(1)
        return text

    train = spark.createDataFrame(rows, "text string, label string").select(F.udf(marked)("text").alias("text"), "label")
    model = G.text_classifier(train, features=64)
    assert read.value <= len(rows) and model.stages[-1].getRegParam() == 1 / 15
    said = G.predicted(model, spark.createDataFrame([("sweet apple",), ("engine oil",)], "text string")).collect()
    assert [r.model_label for r in said] == ["fruit", "car"]
    assert not glob.glob(spark.sparkContext.getCheckpointDir().removeprefix("file:") + "/quillspark/features-*")


def test_top_features_meet_documents_where_they_are(spark):
    out = QUERIES["m6_top_features"](spark, "/root/testdata/sf0.001")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(c, 10, True) for c in ("invoice", "purchase_order", "receipt")]


# exports


def test_four_digits_of_binary_values(spark):
    values = [0.12345, 0.00015, 0.62845, 0.5, 1234.56785, -0.00025, None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", X._four(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [None if v is None else f"{v:.4f}" for v in values]


def test_exports(spark, tmp_path):
    queries = spark.createDataFrame([(1, 'a "quoted", text', "x", False), (2, "b", "y", True), (3, "c", "y", True), (4, "d", "x", False)], "query_id long, query_text string, category string, expects_no_results boolean")
    qrels = spark.createDataFrame([(1, "p", 3), (1, "q", 1), (1, "z", 0), (4, "s", 2)], "query_id long, doc_id string, grade int")
    hits = spark.createDataFrame([(1, 1, "z", 0.5, 5), (1, 2, "p", 0.25, None), (3, 1, "q", 1.0, 2)], "query_id long, rank int, doc_id string, score double, lexical_tier int")
    X.write_query_level(X.query_level(queries, qrels, hits), f"{tmp_path}/csv")
    rows = {}
    for f in glob.glob(f"{tmp_path}/csv/*.csv"):
        with open(f, newline="", encoding="utf-8") as s:
            rows |= {r["query_id"]: r for r in csv.DictReader(s)}
    assert tuple(rows["1"]) == X.COLUMNS and len(rows) == 4
    one = rows["1"]
    assert (one["query_text"], one["gold_relevant_docs"], one["retrieved_doc_ids"], one["first_relevant_rank"], one["top_1_score"], one["top_1_lexical_tier"]) == ('a "quoted", text', "p:3, q:1", "z, p", "2", "0.5000", "5")
    ideal = 7 + 1 / math.log2(3)
    assert (one["p_at_3"], one["r_at_5"], one["rr_at_1"], one["rr_at_3"], one["ndcg_at_3"]) == ("0.3333", "0.5000", "0.0000", "0.5000", f"{7 / math.log2(3) / ideal:.4f}")
    assert [rows[i]["no_match_status"] for i in "1234"] == ["N/A", "PASS", "FAIL", "N/A"] and rows["2"]["retrieved_doc_ids"] == rows["2"]["top_1_doc_id"] == "<none>"
    said = json.loads(X.metrics_json(queries, qrels, hits).first().value)
    assert said["no_match"] == {"total": 2, "correct": 1, "accuracy": 0.5, "status": "FAIL"} and set(said["by_category"]) == {"x"}
    assert said["overall"]["k3"]["precision"] == 0.1667 and said["by_category"]["x"]["query_count"] == 2


def test_probes_go_out_in_small_frames():
    rng = np.random.default_rng(3)
    centres, queries = rng.normal(size=(700, 8)), rng.normal(size=(300, 8))
    least = np.where(np.arange(300) % 2 == 0, 4.0, np.nan)
    frame = V.pd.DataFrame({"query_id": np.arange(300), "query_vector": list(queries), "least": least})
    out = list(V._probed([frame], np.arange(700), centres, np.full(700, 0.25), 3, None))
    assert max(map(len, out)) <= V.PROBE_ROWS
    got = {(r.query_id, r.list): r.place for f in out for r in f.itertuples()}
    products = queries @ centres.T
    bound = products + 0.25 * np.linalg.norm(queries, axis=1)[:, None]
    place = np.argsort(np.argsort(-products, axis=1, kind="stable"), axis=1)
    wanted = {(i, j): place[i, j] for i in range(300) for j in range(700) if place[i, j] >= 3 and (i % 2 or bound[i, j] >= 4.0 - 1e-6)}
    assert got == wanted
