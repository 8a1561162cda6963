"""Ranked search, piece encoding and periodic runs against brute-force versions and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillspark.llm import lexical, pieces, runs

from test_operators import DOCS, ROWS, at, docs, none, plain_words, prose  # noqa: F401

# ranked search

ITEMS = [(1, "the licence OF x1"), (2, None), (3, " ,;"), (4, prose(300, 1)[:200]), (None, "don't end"), (1, "the licence OF x1"), (5, "nowhere"), (6, "the über Été maß the")]


def ranked(rows, items, k):
    """Every document scored for every item."""
    terms = [(i, plain_words(t)) for i, t in rows]
    n, total = sum(bool(w) for _, w in terms), sum(len(w) for _, w in terms)
    df = Counter(x for _, w in terms for x in set(w))
    out = []
    for item_id, text in items:
        scores = []
        for i, w in terms:
            tf, m = Counter(w), 10 + (90 * len(w) * n) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in set(plain_words(text)) if tf[x])
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item_id, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [lexical.MAX_BYTES, 700])
def test_ranked_search(spark, docs, none, most):  # noqa: F811
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("Score", F.lit("x"))
    many = ROWS + [(100 + i, prose(40 + i % 7, i % 31), "en", "s", 1) for i in range(400)]
    df = spark.createDataFrame(many, DOCS).withColumns({"item_id": F.lit(1), "RANK": F.lit(2), "copies": F.lit(3)}).repartition(3)
    for k in (1, 3, 10):
        got = lexical.ranked_search(df, items, k=k, max_bytes=most)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == ranked([r[:2] for r in many], ITEMS, k)
    assert lexical.ranked_search(none, items).count() == 0 and lexical.ranked_search(docs, items.limit(0)).count() == 0


def test_search_stops_at_best_positions():
    """Lists are read only as far as the best positions ask for, and ties of the last score are not missed."""
    r = random.Random(5)
    texts = [" ".join(r.choices([f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)], k=r.randrange(5, 80))) for _ in range(3000)]
    number = {f"w{i}".encode(): i for i in range(60)}
    p = lexical.Postings(texts, number)
    df = np.bincount(p.term, minlength=60)
    weights = np.array([lexical.weight(len(texts), int(d)) for d in df], np.int64)
    x = lexical.Impacts(p, weights, len(texts), int(p.lengths.sum()))
    ids, scratch, looked = np.arange(len(texts)), np.full(60, -1, np.int64), []
    for terms in ([59], [40, 41], [0, 30, 59], list(range(20, 30))):
        best = lexical.Best(10)
        looked.append(lexical.best_positions(x, np.array(terms), ids, np.zeros(len(ids), bool), best, scratch))
        whole = np.bincount(p.doc, np.where(np.isin(p.term, terms), x.impact, 0), len(texts)).astype(np.int64)
        want = sorted((-s, i) for i, s in enumerate(whole.tolist()) if s > 0)[:10]
        assert [(-s, i) for s, i in zip(best.score.tolist(), best.id.tolist(), strict=True)] == want
        again = lexical.best_positions(x, np.array(terms), ids, np.zeros(len(ids), bool), lexical.Best(10), scratch, first=1)
        assert again <= len(texts)
    assert looked[0] < df[59] and (scratch == -1).all() and looked[2] < len(texts) / 2
    full = lexical.Best(1)
    full.add(np.array([10**12]), np.array([1]), np.array([False]))
    assert lexical.best_positions(x, np.array([0, 1]), ids, np.zeros(len(ids), bool), full, scratch) == 0  # no place is read in vain


# pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces(docs, none, library):  # noqa: F811
    got = pieces.piece_code(docs.withColumns({"IDS": F.lit(1), "_cut": F.lit("mine")})).collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = library.encode(r.text or "")
        assert list(r.ids) == want and r.decoded == library.decode(want) and r._cut == "mine"
    assert "text" not in pieces.piece_code(docs, keep=False).columns and pieces.piece_code(none).count() == 0


def test_piece_encoder_equals_the_library(library, monkeypatch):
    monkeypatch.setattr(pieces, "MAX_CACHED", 300)
    coder, r = pieces.Pieces(*pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))), random.Random(2)
    texts = ["", " ", "   a  b", "▁▁a▁ b", "<s> </s> <unk> <0x41>", "x" * 3000, "the" * 400, " " * 300, "日本語😀\x00\r\n\t", '"foo");\r\n', "a.b,c;d", "�́e"]
    texts += ["".join(r.choice("aaabcdehnrst  .,\n1é日😀▁'\"") for _ in range(r.randrange(300))) for _ in range(400)]
    texts += [library.decode([r.randrange(259, 32000) for _ in range(40)]) for _ in range(300)]
    for t in texts:
        ids = np.frombuffer(coder.encode([t])[0], np.int32).tolist()
        assert ids == library.encode(t), t[:80]
        assert coder.decode(ids) == library.decode(ids)
    assert len(coder.cuts) <= 1300 and len(coder.agreed) <= 2000
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(259), r.randrange(3)]) for _ in range(r.randrange(9))]
        assert coder.decode(ids) == library.decode(ids)


def merged(text, rank):
    parts = list(text)
    while True:
        found = [(rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank]
        if not found:
            return parts
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_backtracking_over_any_vocabulary():
    """Vocabularies with pieces that can't be made, better unions of worse parts and ties."""
    r = random.Random(9)
    for _ in range(60):
        names = list(dict.fromkeys("".join(r.choice("ab▁") for _ in range(r.randrange(2, 6))) for _ in range(r.randrange(3, 14))))
        some = ["<unk>", *r.sample(["a", "b", "▁"], r.randrange(4)), *names, *(f"<0x{b:02X}>" for b in range(256))]
        kinds = [2] + [1] * (len(some) - 257) + [6] * 256
        coder = pieces.Pieces(tuple(some), tuple(float(-r.randrange(6)) for _ in some), tuple(kinds), True)
        for _ in range(60):
            t = "▁" + "".join(r.choice("aab▁c") for _ in range(r.randrange(14)))
            assert [p for c in coder.cut(t) for p in coder.split(c)] == merged(t, coder.rank), (some[:20], t)
    assert any(len(coder.split("ab" * n)) for n in (1, 5))


# runs


def runs_by_comparison(words):
    """Every period at every place, then the smallest of a stretch."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed_by_comparison(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_random_texts():
    r = random.Random(4)
    texts = []
    for _ in range(1500):
        t = []
        for _ in range(r.randrange(5)):
            part = [r.randrange(r.choice([2, 3, 50])) for _ in range(r.randrange(1, 9))]
            t += part * r.randrange(1, 8) + part[: r.randrange(len(part) + 1)]
        texts.append(t)
    texts += [[0] * n for n in (0, 1, 5, 6, 7, 100)] + [[0, 1] * 40, [0, 0, 1] * 30 + [0, 0], [i % 37 for i in range(37 * 4)], [i % 37 for i in range(37 * 4 - 1)]]
    lengths = np.array(list(map(len, texts)), np.int64)
    got, begins = runs.runs_of(np.array([x for t in texts for x in t], np.int64), lengths).tolist(), (np.cumsum(lengths) - lengths).tolist()
    want = [[s + b, length, q] for t, b in zip(texts, begins, strict=True) for s, length, q in runs_by_comparison(t)]
    assert got == want and len(want) > 300
    # Texts of one and the same loop, one after the other: nothing of a shorter block may stay from the scale before.
    same = [[i % 30 for i in range(b, b + n)] for b, n in ((0, 147), (3, 331), (29, 120), (0, 119), (5, 400))] * 3
    texts = [[r.randrange(9) for _ in range(r.randrange(40))] + t + [r.randrange(9) for _ in range(r.randrange(20))] * r.randrange(6) for t in same]
    lengths = np.array(list(map(len, texts)), np.int64)
    begins = (np.cumsum(lengths) - lengths).tolist()
    want = [[s + b, length, q] for t, b in zip(texts, begins, strict=True) for s, length, q in runs_by_comparison(t)]
    assert runs.runs_of(np.array([x for t in texts for x in t], np.int64), lengths).tolist() == want
    assert runs.runs_of(np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (0, 3)
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(3, np.int64), np.array([3]), times=1)


def test_runs_of_a_hot_word_are_not_squared():
    n = 400_000
    assert runs.runs_of(np.zeros(n, np.int64), np.array([n])).tolist() == [[0, n, 1]]


LOOPS = ["a b c " * 20, "x y x y " * 9, "w " * 5, "w " * 6, "p q r s p q r s p q r s p q r s t t t t t t"]


def test_find_runs(spark, docs, none):  # noqa: F811
    df = docs.union(spark.createDataFrame([(500 + i, t, "en", "s", 1) for i, t in enumerate(LOOPS)], DOCS))
    got = runs.find_runs(df.withColumns({"RUNS": F.lit(1), "_Left": F.lit("mine")}), collapsed="left").collect()
    assert len(got) == len(ROWS) + len(LOOPS) and {r._Left for r in got} == {"mine"}
    for r in got:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want = runs_by_comparison(words)
        assert [(x.start, x.length, x.period) for x in r.runs] == want and r.left == collapsed_by_comparison(words, want)
    assert {r.doc_id for r in got if r.runs} >= {11, 500, 501, 503, 504} and runs.find_runs(none).count() == 0


def test_op13(spark, docs, tmp_path):  # noqa: F811
    many = ROWS + [(1000 + i, prose(5 + i * 3, i), "en", "s", 1) for i in range(150)] + [(5000 + i, t, "en", "s", 1) for i, t in enumerate(LOOPS)]
    got = runs.op13(spark, at(tmp_path, "documents", spark.createDataFrame(many, DOCS))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, looped = [], 0
    for doc_id, text, *_ in many:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if doc_id is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            looped += 1
        found = runs_by_comparison(words)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(found), *first, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(collapsed_by_comparison(words, found))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and looped > 8


def test_contract_types(spark, docs, tmp_path):  # noqa: F811
    from quillspark.llm import queries

    d = at(tmp_path, "documents", docs.where("doc_id < 6"))
    at(tmp_path, "benchmark", spark.createDataFrame([(1, "a b c d")], "item_id long, text string"))
    contract = {
        "op11_ranked_search": ["item_id:bigint", "rank:int", "doc_id:bigint", "score:bigint"],
        "op12_sentencepiece": ["doc_id:bigint", "n_tokens:bigint", "ids_sha256:string", "decoded_sha256:string"],
        "op13_periodic_runs": ["doc_id:bigint", "n_runs:bigint", "start:bigint", "length:bigint", "period:bigint", "exponent_milli:bigint", "runs_sha256:string", "collapsed_sha256:string"],
    }
    for name, want in contract.items():
        assert [f"{c}:{kind}" for c, kind in queries.queries()[name](spark, d).dtypes] == want
