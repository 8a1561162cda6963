"""Reports, datasets, readers, models and streams on small cases."""

import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import datasets as N
from quillspark.operators import layout as L
from quillspark.operators import metrics as M
from quillspark.operators import reports as P
from quillspark.operators import store as D
from quillspark.operators import training as G
from quillspark.plans.process import process, search_text
from quillspark.sources import files as R
from quillspark.streaming import ingest as I


def test_extraction_scores(spark):
    rows = [("PRESENT", "A b", "a B.", "invoice"), ("PRESENT", "x", None, "invoice"), ("NOT_PRESENT", None, "y", "receipt"), ("AMBIGUOUS", "q", "q", "receipt"), ("PRESENT", "1", "2", "receipt"), ("NOT_PRESENT", None, "", "receipt")]
    got = {(r.slice, r.value): r for r in P.extraction_scores(spark.createDataFrame(rows, "status string, expected string, extracted string, type string"), ["type"]).collect()}
    r = got["all", "all"]
    assert (r.tp, r.fp, r.fn, r.support, r.not_present, r.ambiguous, r.exact) == (2, 1, 1, 3, 2, 1, 1)
    assert (r.precision, r.recall, r.exact_match) == (0.6667, 0.6667, 0.3333) and got["type", "invoice"].recall == 0.5


def test_populations_of_nothing(spark):
    empty = spark.createDataFrame([], "gold string, production string, raw string, extracted boolean")
    assert P.population_metrics(empty, ["a", "b"]).count() == 0
    one = spark.createDataFrame([("a", None, "a", False)], empty.schema)
    got = {(r.population, r.system): r for r in P.population_metrics(one, ["a", "b"]).collect()}
    assert set(got) == {("all", "production"), ("all", "raw")} and got["all", "raw"].accuracy == 1.0 and got["all", "production"].macro_f1 == 0.0


def test_summary_and_weak(spark):
    per = spark.createDataFrame([(1, 5, 0.2, 1.0, 1.0, 1.0), (2, 5, 0.2, 1.0, 0.0, 0.9), (3, 1, 0.0, 0.0, 0.0, 0.0)], "query_id int, k int, precision double, recall double, rr double, ndcg double")
    assert [r.query_id for r in M.weak_queries(per).collect()] == [2]


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,v\n1,"x, ""y"""\n2\n3,z\n', encoding="utf-8")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    row = R.csv_texts(files).first()
    assert row.text == 'Headers: n, v\n\nRow 1: n: 1 | v: x, "y"\nRow 2: n: 3 | v: z' and row.dropped == 1


def test_encodings(spark):
    cases = [("café".encode(), "café"), ("﻿hi".encode(), "hi"), (b"caf\xe9 \x80\x93", "café €“")]
    df = spark.createDataFrame([(bytearray(b), t) for b, t in cases], "content binary, want string")
    assert all(r.got == r.want for r in df.select("want", R.decoded(F.col("content")).alias("got")).collect())


def test_box_lines(spark):
    df = spark.createDataFrame([("1,2,3,4,5,6,7,8,a, b ,c",), ("1,2,3,4,TOTAL 5.00,0.97",), ("plain, text",)], "t string")
    assert [r[0] for r in df.select(R.box_text(F.col("t"))).collect()] == ["a,b,c", "TOTAL 5.00", "plain,text"]


def test_images(spark):
    a = spark.createDataFrame([("x/1.json",), ("x/2.json",)], "path string")
    i = spark.createDataFrame([("y/1.jpg",), ("y/1.PNG",), ("y/3.png",), ("y/2.gif",)], "path string")
    assert {r.stem: r.image for r in R.images_of(a, i).collect()} == {"1": "y/1.PNG", "2": None}


def test_class_folders_and_exports(spark, tmp_path):
    for split, label, name, text in (("train", "invoice", "a", "one"), ("train", "invoice", "b", "two"), ("train", "receipt", "c", " "), ("val", "receipt", "d", "four")):
        (tmp_path / "in" / split / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / split / label / f"{name}.txt").write_text(text)
    rows = N.class_folders(spark, str(tmp_path / "in"))
    assert sorted((r.split, r.label, r.file, r.text) for r in rows.collect()) == [("train", "invoice", "a.txt", "one"), ("train", "invoice", "b.txt", "two"), ("val", "receipt", "d.txt", "four")]
    assert N.class_folders(spark, str(tmp_path / "in"), 1).count() == 2
    N.write_labelled(N.numbered(rows.withColumnRenamed("file", "name")), str(tmp_path / "out"))
    assert sorted(r.file for r in spark.read.parquet(str(tmp_path / "out")).where("label = 'invoice'").collect()) == ["invoice_0001.txt", "invoice_0002.txt"]
    examples = rows.select(F.col("file").alias("id"), F.col("label").alias("prompt"), F.col("text").alias("answer"))
    for kind in ("jsonl", "csv", "parquet", "huggingface", "openai"):
        N.export(examples, str(tmp_path / kind), kind, key="id")
    chat = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "openai")).collect()]
    assert len(chat) == 3 and {m["role"] for c in chat for m in c["messages"]} == {"user", "assistant"}
    assert spark.read.json(str(tmp_path / "jsonl")).count() == spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    with pytest.raises(ValueError):
        N.export(examples, str(tmp_path / "x"), "xml")


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('name,label\na,"x, y"\n')
    assert [tuple(r) for r in N.manifest(spark, str(tmp_path / "m.csv"), "name string, label string").collect()] == [("a", "x, y")]


def test_cache_plan(spark):
    s = spark.createDataFrame([("a", "x"), ("b", None), ("c", " "), ("d", "y")], "name string, text string")
    assert tuple(N.cache_outcome(N.cache_plan(s, s.where("name = 'a'"))).first()) == (4, 1, 1, 1, 1)
    assert N.cache_plan(s, s, overwrite=True).where("action = 'process'").count() == 4


def layout_text(kind, k):
    return {"invoice": f"INVOICE # {k}\nBill To: X{k}\nBalance Due: ${k}.00", "receipt": f"RECEIPT {k}\nCashier 2\nCash {k}.00\nChange 1.00"}[kind]


SIGNS = ("$", "Rs", "RM")


def test_layout_words_are_looked_for_once(spark):
    distinct = lambda lists: len({w for words in lists for w in words})
    looked = re.findall(r"(?<!regexp_)replace\(", str(L.layout_features(F.col("text"))))
    assert len(looked) == distinct([SIGNS]) + distinct(L.TOP.values()) + distinct([L.TOTALS]) + distinct(L.WHOLE.values())
    words = sorted({w for lists in (L.TOP.values(), L.WHOLE.values(), [L.TOTALS, SIGNS]) for words in lists for w in words}) + ["é😀", "\n", " ", "x", "1.50", "12/05/2020", "3 May 2021", ".5", "\u3000\n"]
    draw = random.Random(5)
    texts = [None, "", *["".join(draw.choices(words, k=draw.randint(1, 40))) for _ in range(200)]]
    got = {r.i: r for r in L.with_layout(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    for i, t in enumerate(t or "" for t in texts):
        lines = [s.strip() for s in t.split("\n") if s.strip()]
        k = max(math.ceil(len(lines) / 4), 1)
        top, bottom = ("\n".join(part) + "\n" + chars for part, chars in ((lines[:k], t[:500]), (lines[max(len(lines) - k, 0) :], t[-500:])))
        count = lambda text, words: sum(text.lower().count(w) for w in words)
        want = {n: count(top, w) for n, w in L.TOP.items()} | {n: count(t, w) for n, w in L.WHOLE.items()} | {"bottom_region_total_keyword_count": count(bottom, L.TOTALS), "currency_symbol_count": sum(t.count(w) for w in SIGNS)}
        want |= {"average_line_length": sum(map(len, lines)) / max(len(lines), 1), "line_item_density_proxy": want["item_table_keyword_count"] / max(len(lines), 1)}
        want |= {"amount_like_count": len(re.findall("(?ia)" + L.AMOUNT, t)), "date_like_count": len(re.findall("(?ia)" + L.DATE, t))}
        assert {n: got[i][n] for n in want} == want, t


def test_models(spark, tmp_path):
    rows = spark.createDataFrame([(layout_text(c, k), c) for k in range(12) for c in ("invoice", "receipt")], "text string, label string")
    f = rows.select(L.layout_features(F.col("text")).alias("f")).first().f
    assert (f.char_count, f.line_count, f.bill_to_ship_to_count, f.currency_symbol_count, f.total_near_bottom_proxy) == (len(layout_text("invoice", 0)), 3.0, 1.0, 1.0, 1.0)
    model = L.layout_classifier(rows, features=256)
    assert model.transform(L.with_layout(rows)).where("prediction != _y").count() == 0
    top = G.top_features(model, [f"w{i}" for i in range(512)] + list(L.NAMES), 3).collect()
    assert [(r["class"], r["rank"]) for r in sorted(top, key=lambda r: (r["class"], r["rank"]))] == [(c, n) for c in ("invoice", "receipt") for n in (1, 2, 3)]
    text_model = G.text_classifier(rows, features=256)
    G.save_model(text_model, str(tmp_path / "model"))
    other = spark.createDataFrame([(1, "bill x3 due"), (2, "INVOICE # 77")], "doc_id int, text string")
    got = {r.doc_id: r.classification for r in process(other, model=G.load_model(str(tmp_path / "model"))).select("doc_id", "classification").collect()}
    assert got[1].confidence_source == "model" and got[1].label in ("invoice", "receipt") and 0.5 <= got[1].confidence <= 1
    assert (got[2].label, got[2].confidence_source, got[2].confidence) == ("invoice", "heuristic", None)
    assert "Relevant Content" in search_text(process(other)).first().search_text


def test_vectors_have_one_dimension(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id int, embedding array<double>")
    D.save_vectors(v, str(tmp_path / "v"), 2)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 1
    with pytest.raises(Exception, match="dimension is not 3"):
        D.save_vectors(v, str(tmp_path / "w"), 3)


TEXT = "INVOICE # 12345\nVendor: ABC Trading\nInvoice Date: 2026-01-02\nBalance Due: $10.00 and some more words to be long enough here"


def test_stream_stores_once(spark, tmp_path, monkeypatch):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, user_id long, text string").withColumn("ts", F.lit("2026-01-01 00:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    write([(1, 1, TEXT), (2, 1, TEXT), (3, 2, TEXT), (4, 1, " ")])
    broken, done = {"on": True}, I.tables

    def failing(processed):
        parts = done(processed)
        if broken["on"]:  # two tables are written, then the batch fails
            broken["on"] = False
            parts["validation_results"] = parts["validation_results"].withColumn("x", F.raise_error(F.lit("lost")))
        return parts

    monkeypatch.setattr(I, "tables", failing)
    with pytest.raises(Exception, match="lost"):
        I.ingest(I.read_stream(spark, src), out, ck).awaitTermination()
    assert I.stored(spark, out, "documents") is None
    I.ingest(I.read_stream(spark, src), out, ck).awaitTermination()
    write([(5, 1, TEXT), (6, 3, TEXT)])
    I.ingest(I.read_stream(spark, src), out, ck).awaitTermination()
    ids = lambda name: sorted(r.doc_id for r in I.stored(spark, out, name).select("doc_id").distinct().collect())
    assert ids("documents") == ids("classifications") == ids("extracted_fields") == ids("validation_results") == [1, 3, 6]
    assert [r.doc_id for r in spark.read.parquet(f"{out}/rejected").collect()] == [4]


def test_stream_repeats_and_counts(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(1, 1, "a", "2026-01-01 00:10:00"), (2, 1, "a", "2026-01-01 00:20:00"), (3, 1, "b", "2026-01-01 01:10:00")]
    spark.createDataFrame(rows, "doc_id long, user_id long, text string, at string").select("doc_id", "user_id", "text", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.parquet(src)
    once = I.without_repeats(I.read_stream(spark, src)).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    once.awaitTermination()
    assert sorted(r.text for r in spark.table("once").collect()) == ["a", "b"]
    counts = I.running_counts(I.read_stream(spark, src), "user_id").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert sorted((r.user_id, r.n) for r in spark.table("counts").collect()) == [(1, 1), (1, 2)]
