"""The pipeline on a small table: each stage acts on what the one before it kept."""

import sys

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    clean = "The wise old man of the village went to the river and sat with a friend in the shade of that tree for it was warm as ever be "
    words = clean.split()
    text = lambda k: " ".join(f"{w}{k}" if i % 3 == 0 else w for i, w in enumerate(words * 3))
    leak = " ".join(f"q{i}" for i in range(14))
    rows = [(k, text(k), "en", "s", 1) for k in range(6)] + [(6, text(0), "en", "s", 1), (7, "#*$ " * 200, "en", "s", 1), (8, f"{text(8)} {leak} {text(9)}", "en", "s", 1), (9, f"{text(10)} joe@mail.example.com", "en", "s", 1), (10, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_run(spark, folder):
    import corpus_pipeline

    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 8, 9]
    assert "q5" not in rows[8].text and "[EMAIL]" in rows[9].text and "joe@" not in rows[9].text
    assert all(r.n_chars == len(r.text) for k, r in rows.items() if k in (8, 9)) and all(r.n_tokens * 4 == len(r.ids) for r in rows.values())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.where(F.col("doc_id") < 6).collect()}
    assert all(rows[k].text == kept[k] for k in kept)


def test_empty(spark, folder, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_the_entry_guards_the_import():
    import __spark_entry__

    assert {f"op{n}_" for n in range(1, 11)} <= {k.split("_")[0] + "_" for k in __spark_entry__.queries()} and "pipeline" in __spark_entry__.queries()
    assert "quillspark.llm" not in sys.modules or not any(m.startswith("quillspark.operators") for m in __import__("quillspark.llm.queries", fromlist=["x"]).__dict__)
