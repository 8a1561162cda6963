"""Each operator against a brute-force version, on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, decontam, licenses, ngramjoin, pii, quality, sharding, tokbin, tokcount, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(7)
VOCABULARY = ["the", "of", "and", "to", "licence", "Été", "maß", "x1", "don't", "end.", "A", "über", "42"]


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "a b c d",
    prose(60),
    prose(60),
    prose(60) + " end",
    prose(300, 1),
    prose(300, 1).replace("the", "THE", 2),
    "line one\nline one\n\nline two\nline one \n" + prose(55, 2),
    "spam " * 90,
    "### $$$ " * 40 + prose(30, 3),
    prose(4000, 4),
    "mail a.b@x-y.co.uk, b@c d@e.f 1.2.3.4 1.2.3.400 card 4111 1111 1111 1111 +1 (988) 555-2485 password=b7db7aa4a5fcc78305 é token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\"",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0. the mit license",
    "This work is licensed under the GNU General Public License, version 3. CC BY-NC 4.0",
    "x" * 3000,
    "<|endoftext|> it's 日本語 😀  \n",
]
ROWS = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 1), (None, TEXTS[8], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def at(tmp_path, name, df):
    """A folder that holds df as a table."""
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# decontamination


def contamination(text, items, size=10):
    words, hit, found = plain_words(text), set(), set()
    for item_id, item in items:
        w = plain_words(item)
        k = min(size, len(w))
        for p in range(len(w) - k + 1) if k else ():
            for q in range(len(words) - k + 1):
                if words[q : q + k] == w[p : p + k]:
                    hit |= set(range(q, q + k))
                    found.add(item_id)
    return len(words), len(hit), sorted(i for i in found if i is not None)


ITEMS = [(1, prose(300, 1)[200:330]), (2, "don't end a the"), (3, None), (4, " "), (5, "x1"), (None, "the of the"), (2, "don't end a the"), (12, prose(4000, 4)[9000:9200])]


def test_contamination(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for most in (decontam.MAX_WORDS, 40):  # one broadcast, and an equi-join
        got = decontam.find_contamination(docs.withColumn("Contamination", F.lit(1)), items, max_words=most).collect()
        assert len(got) == len(ROWS)
        for r in got:
            c = r["contamination"]
            assert (c.n_words, c.n_hit, list(c["items"])) == contamination(r.text, ITEMS), r.text
            assert sum(b - a for a, b in c.hits) == c.n_hit
    assert decontam.find_contamination(none, items).count() == 0
    assert {r.contamination.n_hit for r in decontam.find_contamination(docs, items.limit(0)).collect()} == {0}


def test_contamination_removed(spark, docs):
    items = spark.createDataFrame([(1, prose(300, 1)[200:330])], "item_id long, text string")
    kept = decontam.decontaminate(docs, items, remove="documents")
    assert kept.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {8, 9}
    for most in (decontam.MAX_WORDS, 40):
        cut = decontam.decontaminate(docs.withColumns({"_found": F.lit(1), "_row": F.lit(2)}), items, remove="spans", max_words=most)
        assert cut.columns == [*docs.columns, "_found", "_row"] and cut.count() == len(ROWS)
        assert {r.contamination.n_hit for r in decontam.find_contamination(cut, items).collect()} == {0}
        assert [tuple(r) for r in cut.where("doc_id = 13").select("text", "_found", "_row").collect()] == [(TEXTS[13], 1, 2)]


def test_contamination_set_is_bounded():
    r = random.Random(3)
    grams = decontam.NgramSet([(1, " ".join(f"w{r.randrange(1 << 40)}" for _ in range(20_000)))], 10)
    assert grams.nbytes() < 220 * 20_000


# BPE


def test_bpe(docs, none):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.bpe_decode(bpe.bpe_encode(docs.withColumn("IDS", F.lit(1))))
    got = coded.collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    once = {(r.doc_id, r.text): (r.ids, r.decoded) for r in bpe.bpe_code(docs.withColumn("IDS", F.lit(1))).collect()}
    assert once == {(r.doc_id, r.text): (r.ids, r.decoded) for r in got}
    assert {r.doc_id: r.text for r in bpe.bpe_code(docs, into="text").where("doc_id < 9").collect()} == {r.doc_id: r.decoded for r in got if r.doc_id is not None and r.doc_id < 9}
    assert [list(r.a) for r in bpe.bpe_encode(docs).where("doc_id = 4").select(bpe.ids_array(F.col("ids")).alias("a")).collect()] == [library.encode("a b c d").ids]
    assert bpe.bpe_encode(none).count() == 0


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CACHED", 5)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = bpe.Encoder(bpe.Merges(f.read()), public_tokenizers.PATTERN)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for seed in range(4):
        assert np.frombuffer(enc.encode([prose(50, seed)])[0], "<u4").tolist() == library.encode(prose(50, seed)).ids
        assert len(enc.index) <= 50


# quality


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams, covered = {}, set()
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    for starts in grams.values():
        if len(starts) > 1:
            covered |= {p + k for p in starts for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(docs, none):
    got = quality.quality(docs.withColumn("KEPT", F.lit("x")).withColumn("measures", F.lit(0))).collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = measured(r.text)
        assert tuple(r.measures[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, r.text
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept) and r.kept == (not r.failed)
    assert quality.quality(none).count() == 0


def test_quality_of_texts_beyond_the_key(monkeypatch, docs):
    monkeypatch.setattr(quality, "_POS_BITS", 5)
    for r in quality.measures(docs).collect():
        assert r.measures.n_repeat_words == measured(r.text)[4]


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text, kind):
    out = []
    for m in re.finditer(PATTERNS[kind], text or ""):
        digits = re.sub("[^0-9]", "", m[0])
        if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
            out.append((m.start(), m.end()))
    return out


def test_personal_data(spark, docs, none):
    more = ["a@b.c_d@e.f 1.2.3.4.5.6.7.8 1.2.3.004 a..b@x-y.zz..", "x 00000001.2.3.4 4111111111111112 +1((((((( 4111111111111111 5", "a" * 20000 + "@b", "1 " * 3000 + "+1-" * 500, "é@a.b " * 400]
    more += ["".join(R.choice("a1@.+- (é") for _ in range(200)) for _ in range(60)]
    both = docs.union(spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(more)], DOCS))
    got = pii.find_pii(both).collect()
    assert len(got) == len(ROWS) + len(more)
    for r in got:
        for kind in PATTERNS:
            assert [(s.start, s.end) for s in r.pii[kind]] == personal(r.text, kind), (kind, r.text[:80])
        for s in r.pii.secret:
            assert r.text[s.start : s.end] == s.text
    assert pii.find_pii(none).count() == 0


def test_secrets_and_redaction(docs):
    found = {s.text for r in pii.find_pii(docs).collect() for s in r.pii.secret}
    assert found == {"b7db7aa4a5fcc78305", "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"}
    text = pii.redact(docs).where("doc_id = 14").first().text
    assert text == 'mail [EMAIL], b@c [EMAIL] [IP] 1.2.3.400 card [CARD] [PHONE] password=[SECRET] é token = "[SECRET]"'
    untouched = {r.doc_id: r.text for r in pii.redact(docs).where("doc_id != 14").collect()}
    assert all(untouched[i] == TEXTS[i] for i in untouched)


def test_secrets_that_overlap_base_spans(spark, docs):
    tokens = ["1beb4111111111111111ad40cdbb6ae7f578ae00", "4111111111111111abcdef0123456789abcdef01", "b7db7aa4+12025550123a5fcc78305"]
    rows = [(100 + i, f'key {i}, token = "{t}" end', "en", "s", 1) for i, t in enumerate(tokens)] + [(200, "to a1b2c3d4@x-y1234567.com", "en", "s", 1)]
    both = docs.union(spark.createDataFrame(rows, DOCS))
    got = {r.doc_id: r.pii for r in pii.find_pii(both).where("doc_id >= 100").collect()}
    cut = {r.doc_id: r.text for r in pii.redact(both).where("doc_id >= 100").collect()}
    for i, t in enumerate(tokens):
        p = got[100 + i]
        assert [x.text for x in p.secret] == [t] and len(p.card) + len(p.phone) == 1
        assert cut[100 + i] == f'key {i}, token = "[{"CARD" if t.startswith("4111") else "SECRET"}]" end'
    assert got[200].secret == [] and cut[200] == "to [EMAIL]"


def test_labelers_are_weighed():
    def seen(classes, **votes):
        """A pattern of the votes of some labelers and the classes of size, digits and cases."""
        assert set(votes) <= {v.name for v in pii.LABELERS} and len(classes) == len(pii._CLASSES)
        return "".join(str(votes.get(v.name, "-")) for v in pii.LABELERS) + classes

    secret, key = seen("310", hex=1, mixed=1, gazetteer=1, assigned=1), seen("211", key_id=1, mixed=1, assigned=1)
    model, plain = seen("000", key_id=0, mixed=0, prose=0), seen("100", key_id=0, prose=0)
    counts = {secret: 400, key: 300, model: 5000, seen("110", enclosed=1): 40, plain: 900}
    assert set(pii.accepted(counts)) >= {secret, key} and not {model, plain} & set(pii.accepted(counts))
    assert pii.accepted({}) == []


# sharding


def test_shards(spark, docs, none):
    many = [(i % 700 if i < 900 else i, ["same text", None, "", prose(20, i % 50)][i % 4] if i % 3 else "one hot text", "en", "s", 0) for i in range(3000)] + [(1, "again", "en", "s", 0)] * 300
    df = spark.createDataFrame(many, DOCS).withColumn("SHARD", F.lit(1))
    got = sharding.shard(df, shards=7).collect()
    assert len(got) == len(many)
    size, slots = {}, {}
    for r in got:
        data = (r.text or "").encode()
        assert r.size == len(data) + 16 and r.text_crc32 == zlib.crc32(data) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(size.values()) / 7
    assert sorted(size) == list(range(7)) and all(abs(s - mean) <= 2 * (0.002 * mean + max(r.size for r in got)) for s in size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none, shards=3).count() == 0 and sharding.shard(docs, shards=40).count() == len(ROWS)
    assert {r.shard for r in sharding.shard(docs, shards=1).collect()} == {0}


# n-gram Jaccard join


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(rows):
    sets, root = [shingle_set(t) for _, t, *_ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), r[0] if not sets[i] else low.get(find(i))) for i, r in enumerate(rows)), key=str)


def test_near_duplicates(spark, docs, none):
    rows = list(ROWS)
    base = [f"w{i}" for i in range(130)]
    passage = " ".join(f"p{i}" for i in range(60))
    for k in range(120):  # drifting copies: neighbours link, far ones do not; and texts that share a passage
        r = random.Random(k)
        rows.append((1000 + k, " ".join(f"{k // 40}{w}" if r.random() < 0.012 * (k % 9) else w for w in base), "en", "s", 1))
        rows.append((2000 + k, f"{passage} " + " ".join(f"t{k}_{i}" for i in range(r.choice([10, 40, 200]))), "en", "s", 1))
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.classify(df).collect()), key=str)
    assert got == near_groups(rows)
    kept = ngramjoin.keep_one(df)
    assert kept.columns == df.columns
    want = len({c for i, n, c in got if n}) + sum(n == 0 for _, n, _ in got)
    assert kept.count() == want
    assert ngramjoin.classify(none).count() == 0 and ngramjoin.keep_one(none).count() == 0


def test_one_of_each_group_with_null_and_repeated_ids(spark):
    near = [[prose(200, seed), prose(200, seed) + " one", prose(200, seed) + " one two"] for seed in (21, 22, 23, 24)]
    ids = [(None, None, None), (None, None, None), (7, 7, 9), (7, 7, None)]
    rows = [(i, t, "en", "s", 1) for k in range(4) for i, t in zip(ids[k], near[k], strict=True)] + [(None, near[0][0], "en", "s", 1), (None, " ", "en", "s", 1), (None, None, "en", "s", 1)]
    for data in (rows, rows[::-1]):
        kept = [(r.doc_id, r.text) for r in ngramjoin.keep_one(spark.createDataFrame(data, DOCS)).collect()]
        groups = [[(i, t) for i, t in kept if t in near[k]] for k in range(4)]
        assert [len(g) for g in groups] == [1, 1, 1, 1] and [g[0][0] for g in groups] == [None, None, 7, 7]
        assert len(kept) == 6 and {(None, " "), (None, None)} < set(kept)
        assert data is rows or sorted(kept, key=str) == first
        first = sorted(kept, key=str)


def test_rtree_join_is_exact():
    r = np.random.default_rng(1)
    for n in (1, 5, 40, 300):
        v = r.poisson(3, (n, 16)).astype(np.int32)
        v[: n // 3] = v[0]
        sizes = v.sum(1)
        tree = ngramjoin.RTree(sizes, v)
        got = set(zip(*map(np.ndarray.tolist, tree.pairs(tree)), strict=True))
        want = {(i, j) for i in range(n) for j in range(n) if 100 * min(sizes[i], sizes[j]) >= 80 * max(sizes[i], sizes[j]) and np.minimum(v[i], v[j]).sum() >= ngramjoin.needed(int(sizes[i]), int(sizes[j]))}
        assert want <= got


# token counts


def test_token_counts(spark, docs, none):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = ["", " ", "\n\n", "'ll", "re", "hello world", "é😀", None, "word " * 80, "<|endoftext|>"]
    rows = []
    for i, t, *_ in ROWS * 4:
        n = len(t or "")
        rows.append((i, t, [(R.randrange(-2, n + 3), R.choice([0, 1, 7, n // 2, -1]), R.choice(pieces)) for _ in range(R.randrange(4))] if R.random() < 0.9 else None))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {tokcount.EDITS}")
    for r in tokcount.count_tokens(df, edits="edits").collect():
        text = r.text or ""
        assert r.token_counts.n_before == len(library.encode(text, add_special_tokens=False).ids)
        for e in r.edits or []:
            p = min(max(0, e["at"]), len(text))
            text = text[:p] + (e["insert"] or "") + text[p + max(0, e["remove"]) :]
        assert r.token_counts.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
    assert tokcount.count_tokens(none).count() == 0


def test_edits_encode_little_anew(docs):
    r = tokcount.count_tokens(docs.where("doc_id = 13").withColumn("edits", tokcount.sample_edits(F.col("text"))), edits="edits").first().token_counts
    assert r.n_edits == 3 and r.n_reencoded < 60 < 4000 < r.n_pretokens


# token files


def test_token_files(spark, docs, none):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = tokbin.read_tokens(spark, tokbin.write_tokens(docs, file_ids=200), ids=True).collect()
    want = sorted(([i if i is not None else -1, [*library.encode(t or "", add_special_tokens=False).ids, 2]] for i, t, *_ in ROWS), key=lambda x: x[0])
    got.sort(key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [i for i, _ in want]
    start = 0
    for r in got:
        assert (r.start, r.n_tokens) == (start, len(r.ids)) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(ids) for _, ids in want)
    assert tokbin.read_tokens(spark, tokbin.write_tokens(none)).count() == 0


def test_elias_fano():
    for n in (0, 1, 5, 64, 65, 1000):
        v = np.sort(np.random.default_rng(n).integers(0, 1 << (n % 50 + 1), n)).astype(np.uint64)
        e, rest = tokbin.EliasFano.unpack(memoryview(tokbin.EliasFano.of(v).pack() + b"xyz"))
        assert bytes(rest) == b"xyz" and (e.all() == v).all() and [e.get(i) for i in range(n)] == v.tolist()
        assert n < 64 or len(e.pack()) < n * 8


# WARC


def test_warc(spark):
    big, rows = "<p>é</p>" * 30, []
    rows = [(3, "http://a/1 x\n", big), (1, "http://a/2", big), (2, None, big), (7, "u", None), (8, "u", ""), (9, "u", "short"), (10, "u", "short"), (None, "u", big), (1, "http://a/2", big), (11, "u", "z" * 100), (12, "u", "z" * 100), (13, "u", "z" * 99), (14, "u", "z" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc.read_warc(spark, warc.write_warc(pages, file_bytes=300), payloads=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    text = {i: h for i, _, h in rows}
    for r in got:
        h = text[r.page_id] or ""
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), hashlib.sha256(h.encode()).hexdigest())
        again = r.page_id is not None and h in first and r.page_id > first[h]
        assert (r.record_type, r.refers_to) == (("revisit", first[h]) if again else ("response", None))
        assert r.payload == (None if again else h)
    assert {r.url for r in got if r.page_id in (1, 2, 3)} == {"http://a/2", None, "http://a/1 x%0A".replace(" ", "%20")} or {r.url for r in got if r.page_id == 2} == {None}
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0


def test_warc_files_do_not_depend_on_partitions(spark):
    rows = [(i % 400 - 100 if i % 9 else None, f"http://a/{i}", f"<p>{prose(5 + i % 40, i % 300)}</p>") for i in range(600)]
    pages, before, found = spark.createDataFrame(rows, "page_id long, url string, html string"), spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for dealt, shuffled in ((1, 1), (7, 3), (3, 11)):
            spark.conf.set("spark.sql.shuffle.partitions", shuffled)
            path = warc.write_warc(pages.repartition(dealt), file_bytes=2000, range_bytes=20000)
            found.append(sorted(map(tuple, spark.read.parquet(f"{path}/manifest").select("part", "seq", "n_records", "n_bytes", "sha256").collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len({f[0] for f in found[0]}) > 5 and len(found[0]) > len({f[0] for f in found[0]})
    assert sum(f[2] for f in found[0]) == len(rows)
    image = spark.read.parquet(f"{path}/files").where("part = 1 and seq = 0").first().image
    assert next(iter(warc.members(image))).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and warc.file_name(1, 0).encode() in next(iter(warc.members(image)))


# licenses

PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def test_licenses(docs, none):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs.withColumn("SCORE", F.lit(1))).collect()}
    for r in got.values():
        w, starts, labels = plain_words(r.text), [], set()
        for phrase, label in PHRASES:
            p = phrase.split()
            for i in range(len(w)):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[15].labels == "apache-2,mit" and got[16].labels == "cc-by-nc,gpl-3"
    assert licenses.scan_licenses(none).count() == 0


def test_license_key_phrase_is_required(spark):
    df = spark.createDataFrame([(1, "the gnu general public was licensed under version 3 of the license"), (2, "x permission is hereby granted free of charge to any person obtaining a copy of this software")], "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(df).collect()}
    assert got[1] == ("", 0.0) and got[2][0] == "mit" and 0.5 < got[2][1] < 1


def test_base_phrases_are_whole(spark):
    rows = [(1, "See the MIT License text"), (2, "it is under the MIT license, and under  the MIT-license"), (3, "understand the mit license"), (4, "Apache License 2"), (5, "CC BY-NC"), (6, None)]
    got = {r.doc_id: (r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, None, None, ""), 2: (2, 2, 7, "mit"), 3: (0, None, None, ""), 4: (0, None, None, ""), 5: (1, 0, 0, "cc-by-nc"), 6: (0, None, None, "")}


def judged(text):
    """Labels and score by trying every template at every word."""
    words, found, labels = plain_words(text), [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        labels |= {label for i in range(len(words)) if words[i : i + len(p)] == p}
    score = 1.0 if labels else 0.0
    for t in licenses.TEMPLATES:
        whole, key = t.text.split(), t.key.split()
        before = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        for i in range(len(words)):
            if words[i : i + len(key)] == key:
                found.append(sum(0 <= i - before + j < len(words) and words[i - before + j] == w for j, w in enumerate(whole)) / len(whole))
                labels.add(t.label)
    return ",".join(sorted(labels)), max([score, *found])


def test_several_licenses_in_a_text(spark):
    r = random.Random(3)
    mit, gpl, bsd = (next(t.text for t in licenses.TEMPLATES if t.label == x and len(t.key) > 25) for x in ("mit", "gpl-3", "bsd"))
    texts = [f"{mit}. {gpl}", f"{bsd} -- {mit} -- {gpl}", " ".join(t.text for t in licenses.TEMPLATES), " ".join(t.key for t in licenses.TEMPLATES)]
    texts += [f"{prose(40)} any associated charge copy documentation files free obtaining person software {prose(40)} {t.key} 7" for t in licenses.TEMPLATES]
    words = sorted({w for t in licenses.TEMPLATES for w in t.text.split()})
    for _ in range(30):
        parts = [r.choice(licenses.TEMPLATES).text for _ in range(r.randint(1, 4))] + [" ".join(r.choice(words) for _ in range(15)) for _ in range(2)]
        r.shuffle(parts)
        cut = " ".join(parts).split()
        for _ in range(3):
            cut[r.randrange(len(cut))] = r.choice(words)
        texts.append(" ".join(cut[r.randint(0, 6) :]))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == (judged(t)[0], pytest.approx(judged(t)[1])), t


# names and types


def test_extra_columns_keep_their_values(spark, docs):
    names = ["_base", "_cand", "_w_base", "_w_cand", "_pii", "_scan", "_q_words", "_q_dup", "_found", "_row", "_contamination_0", "_stay_id", "_stay_th", "_stay_mark", "_keep_th", "c_0", "cell", "before", "k1"]
    wide = docs.withColumns({n: F.lit(f"mine {n}") for n in names})
    items = spark.createDataFrame([(1, "of the"), (2, "a b c d")], "item_id long, text string")
    calls = {
        "pii": pii.find_pii(wide),
        "redact": pii.redact(wide),
        "licenses": licenses.scan_licenses(wide),
        "quality": quality.quality(wide),
        "contamination": decontam.find_contamination(wide, items),
        "decontaminate": decontam.decontaminate(wide, items),
        "keep_one": ngramjoin.keep_one(wide),
        "shard": sharding.shard(wide),
    }
    for what, df in calls.items():
        rows = df.select(*names).distinct().collect()
        assert len(rows) == 1 and all(rows[0][n] == f"mine {n}" for n in names), what


def test_sharding_in_cells(docs):
    rows = sharding.shard(docs, shards=3, cell_rows=2).collect()
    assert len(rows) == len(ROWS)
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


CONTRACT = {
    "op1_decontamination": "doc_id n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op2_bpe": "doc_id n_tokens:bigint ids_sha256:string decoded_sha256:string",
    "op3_quality_rules": "doc_id n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op4_pii": "doc_id n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    "op5_sharding": "doc_id size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op6_ngram_jaccard": "doc_id n_shingles:bigint component_id:bigint",
    "op8_token_files": "doc_id start:bigint n_tokens:bigint ids_crc32:bigint",
    "op9_warc": "page_id payload_bytes:bigint payload_digest:string record_type:string refers_to:bigint",
    "op10_license_scan": "doc_id n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string score:double",
}


def test_contract_types(spark, docs, tmp_path):
    from quillspark.llm import queries

    d = at(tmp_path, "documents", docs.where("doc_id < 6"))
    at(tmp_path, "pages", spark.createDataFrame([(1, "u", "x" * 120)], "page_id long, url string, html string"))
    at(tmp_path, "benchmark", spark.createDataFrame([(1, "a b c d")], "item_id long, text string"))
    for name, want in CONTRACT.items():
        have = dict(queries.queries()[name](spark, d).dtypes)
        for column in want.split():
            c, _, kind = column.partition(":")
            assert c in have and (not kind or have[c] == kind), (name, c, have.get(c))


def test_secrets_recall_and_precision(spark):
    """Planted credentials and look-alikes: at least 0.9 of the ones are found, at least 0.9 of what is found are such."""
    r = random.Random(11)
    run = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexa, mixed, upper = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    forms = ['token = "{}"', "api_key: {}", "password={}", "export SECRET='{}'", "Authorization: Bearer {}", 'access_key = "{}",']
    plain = ["see chapter{} of it", "room b{} was full", "model x{}-pro is new", "on 2024-05-{}T10 we met", "version v{}.2beta1"]
    rows, secrets = [], set()
    for i in range(400):
        s = run(hexa, 40) + "a1" if i % 3 == 0 else run(upper, 18) + "A7" if i % 3 == 1 else run(mixed, 28) + "b9"
        secrets.add(s)
        rows.append((i, f"some words go {r.choice(forms).format(s)} and on"))
        rows.append((1000 + i, f"some words {r.choice(plain).format(r.randrange(10, 99))} and so on"))
    found = [s.text for x in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in x.pii.secret]
    right = sum(s in secrets for s in found)
    assert right / len(secrets) >= 0.9 and right / len(found) >= 0.9, (right, len(secrets), len(found))


def test_account_numbers(spark):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 now", "DE89370400440532013000", "pay to GB82 WEST 1234 5698 7654 33 now", "XDE89370400440532013000", None]
    got = {x.i: [(s.start, s.text) for s in x.pii.iban] for x in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    assert got == {0: [(7, "GB82 WEST 1234 5698 7654 32")], 1: [(0, "DE89370400440532013000")], 2: [], 3: [], 4: []}
