"""Benchmark decontamination: a hash set of normalised test n-grams scanned over document words.

A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII. A window is ``size`` consecutive words of an
item; an item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

Each task looks words up in the items' small vocabulary, hashes windows of known words with a rolling polynomial and tests
them against the sorted hash set; every hash that is found is verified word by word, so collisions never count.

The set is broadcast only while the items have at most ``max_words`` words in all. Every word begins at most one window (hash,
place in the item lists, item and ``size`` word ids: 24 + 4 * size bytes) and adds at most one word to the vocabulary (about
130 bytes and the word itself), so 400 000 words take at most some 80 MB, whatever they are. Beyond the bound nothing is
broadcast: windows of documents and items meet in an equi-join on their hashes, and what meets is verified in the documents'
words. Both ways give the same rows.

Defined cases: null or empty texts have no words and no hits; null item texts give no windows; items with a null id mark
words as hit but are not listed; repeated items count once; repeated documents are judged one by one; very long texts are
scanned whole; an empty benchmark or empty documents give no hits or no rows. Extra columns pass through under whatever
names; a column named like the result is replaced.
"""

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, saved, table, trimmed

SIZE = 10
#: Words of all items that one broadcast may hold.
MAX_WORDS = 400_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.LongType(), False)),
        T.StructField("hits", T.ArrayType(T.ArrayType(T.LongType(), False), False)),
    ]
)
_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("hits", pa.list_(pa.list_(pa.int64())))])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def _mix(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of the window that starts at each position (as far as there is one)."""
    mixed, n = _mix(ids), max(0, len(ids) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = out * _BASE + mixed[k : k + n]
    return out


class NgramSet:
    """Windows of the items: a vocabulary, and for each length of a window the distinct ones by hash (hashes, word ids), with
    the items of each one (offsets, item numbers)."""

    def __init__(self, items: list[tuple], size: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        found: dict[int, list] = {}
        for number, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int32)
            if length := min(size, len(ids)):
                grams = np.lib.stride_tricks.sliding_window_view(ids, length)
                found.setdefault(length, []).append((grams, _hashes(ids, length), np.full(len(grams), number, np.int32)))
        self.windows = {}
        for length, parts in found.items():
            grams, hashes, numbers = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.lexsort((numbers, *grams.T[::-1], hashes))
            grams, hashes, numbers = grams[order], hashes[order], numbers[order]
            new = np.r_[True, (grams[1:] != grams[:-1]).any(1)]
            starts = np.flatnonzero(new)
            self.windows[length] = (hashes[starts], grams[starts], np.r_[starts, len(numbers)].astype(np.int32), numbers)

    def nbytes(self) -> int:
        return sum(x.nbytes for w in self.windows.values() for x in w) + sum(len(w) + 130 for w in self.vocabulary)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans [start, end) of hit words, and the items whose windows occur."""
        get = self.vocabulary.get
        ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(ids >= 0)
        spans, found = [], set()
        if not len(known):
            return spans, found
        # runs of known words
        breaks = np.flatnonzero(np.diff(known) > 1)
        starts, ends = known[np.r_[0, breaks + 1]], known[np.r_[breaks, len(known) - 1]] + 1
        for length, (hashes, grams, offsets, numbers) in self.windows.items():
            for a, b in zip(starts[ends - starts >= length], ends[ends - starts >= length], strict=True):
                got = _hashes(ids[a:b], length)
                at = np.searchsorted(hashes, got)
                for p in np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == got):
                    k = at[p]
                    while k < len(hashes) and hashes[k] == got[p]:
                        if (grams[k] == ids[a + p : a + p + length]).all():
                            spans.append((int(a + p), int(a + p + length)))
                            found.update(self.items[i] for i in numbers[offsets[k] : offsets[k + 1]])
                        k += 1
        return merged(spans), found


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def _small(benchmark: DataFrame, max_words: int) -> bool:
    """Whether the items' words and characters fit the bound of the broadcast."""
    n = _items(benchmark).agg(F.sum(F.regexp_count("text", F.lit(_WORD))).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    return (n.words or 0) <= max_words and (n.bytes or 0) <= 64 * max_words


def _scanned(docs: DataFrame, benchmark: DataFrame, text: str, size: int, into: str | None) -> DataFrame:
    """docs with the struct named into; without a name, docs with the hit spans cut out of the text."""
    grams_ = docs.sparkSession.sparkContext.broadcast(NgramSet([tuple(r) for r in _items(benchmark).collect()], size))
    schema = T.StructType([*docs.schema.fields, T.StructField(into, RESULT)]) if into else docs.schema
    at = docs.columns.index(text)

    def run(batches):
        grams = grams_.value
        for batch in batches:
            rows, texts = [], []
            for value in batch.column(at):
                value = value.as_py()
                words = words_of(value)
                spans, items = grams.scan(words)
                if into:
                    rows.append({"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "items": sorted(i for i in items if i is not None), "hits": [list(s) for s in spans]})
                else:
                    texts.append(_without(value, spans) if spans else value)
            if into:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _KIND)], names=[*batch.schema.names, into])
            else:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(trimmed(run), schema)


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, size: int, into: str) -> DataFrame:
    """The same struct by an equi-join of hashed windows; nothing is broadcast. The documents are written once with row numbers."""
    row = free_name(docs, "_row", into)
    docs = saved(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-rows")
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(_WORD), F.lit(0))
    gram = lambda p, k: F.array_join(F.slice("w", p + 1, k), " ")
    items = _items(benchmark).select("item_id", words.alias("w")).where(F.size("w") > 0).withColumn("k", F.least(F.lit(size), F.size("w")))
    items = items.select("item_id", "k", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("k"))).alias("p")).select("item_id", "k", gram(F.col("p"), F.col("k")).alias("g")).distinct()
    items = saved(items.withColumn("h", F.xxhash64("g")), "decontam-windows")
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # at most ``size`` of them
    w = docs.select(F.col(row).alias("r"), F.col(text).cast("string").alias("text")).select("r", words.alias("w"))
    kind = "array<struct<k:int,p:int,h:bigint>>"

    def starts(k: int):
        one = lambda p: F.struct(F.lit(k).alias("k"), p.alias("p"), F.xxhash64(gram(p, F.lit(k))).alias("h"))
        return F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(0), F.size("w") - k), one)).otherwise(F.array().cast(kind))

    windows = F.flatten(F.array(F.array().cast(kind), *map(starts, lengths)))
    met = w.select("r", F.explode(windows).alias("s")).select("r", "s.*").join(items, ["k", "h"]).select("r", "k", "p", "g", "item_id")
    hits = met.join(w, "r").where(gram(F.col("p"), F.col("k")) == F.col("g"))
    span = F.array(F.col("p").cast("long"), (F.col("p") + F.col("k")).cast("long"))
    per = hits.groupBy("r").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.array_sort(F.collect_set(span)).alias("spans"))
    kind = "struct<done:array<array<bigint>>,last:array<bigint>>"
    step = lambda a, s: F.when(a["last"].isNull(), F.struct(a["done"].alias("done"), s.alias("last"))).when(s[0] <= a["last"][1], F.struct(a["done"].alias("done"), F.array(a["last"][0], F.greatest(a["last"][1], s[1])).alias("last"))).otherwise(F.struct(F.concat(a["done"], F.array(a["last"])).alias("done"), s.alias("last"))).cast(kind)
    union = F.aggregate("spans", F.struct(F.array().cast("array<array<bigint>>").alias("done"), F.lit(None).cast("array<bigint>").alias("last")).cast(kind), step, lambda a: F.when(a["last"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["last"]))))
    per = per.select("r", "items", union.alias("hits"))
    found = w.select("r", F.size("w").cast("long").alias("n")).join(per, "r", "left")
    none = F.array().cast("array<bigint>")
    whole = F.struct(
        F.col("n").alias("n_words"),
        F.aggregate(F.coalesce("hits", F.array().cast("array<array<bigint>>")), F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("hits", F.array().cast("array<array<bigint>>")).alias("hits"),
    )
    found = found.select(F.col("r").alias(row), whole.alias(into))
    return docs.join(found, row).drop(row)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", size: int = SIZE, max_words: int = MAX_WORDS, into: str = "contamination") -> DataFrame:
    """docs with a struct: n_words, n_hit, items (ids of the items found) and hits (spans of words, end exclusive)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()])
    return (_scanned if _small(benchmark, max_words) else _joined)(docs, benchmark, text, size, into)


def _without(text: str, spans: list) -> str:
    """text without the hit words and what stands between the words of a span."""
    data = text.encode("utf-8", "replace")
    flat = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[0, flat.astype(np.int8), 0]))
    starts, ends = edge[::2], edge[1::2]
    keep, at = [], 0
    for a, b in spans:
        keep.append(data[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*keep, data[at:]]).decode("utf-8", "replace")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", size: int = SIZE, max_words: int = MAX_WORDS) -> DataFrame:
    """docs without contamination: remove='documents' drops documents with a hit, remove='spans' cuts the hit spans out of the text."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove: spans or documents")
    if remove == "spans" and _small(benchmark, max_words):
        return _scanned(docs, benchmark, text, size, None)
    into = free_name(docs, "_found")
    found = find_contamination(docs, benchmark, text, size, max_words, into)
    if remove == "documents":
        return found.where(F.col(f"{into}.n_hit") == 0).select(*docs.columns)
    at = docs.columns.index(text)

    def cut(batches):
        for batch in batches:
            hits = batch.column(len(docs.columns)).field("hits").to_pylist()
            columns = list(batch.columns)[:-1]
            texts = [_without(t, h) if t is not None and h else t for t, h in zip(columns[at].to_pylist(), hits, strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return found.select(*docs.columns, into).mapInArrow(trimmed(cut), docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    """find_contamination() of all documents against the whole benchmark, as the contract's digest columns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    found = find_contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contamination.*")
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")).to(T._parse_datatype_string(schema))


def sha(items) -> str:
    """The digest of found items, for tests."""
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()


ORACLE = r"""
with dw as (select doc_id, row_number() over () rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
iw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
ig as (select distinct item_id, k, array_to_string(w[p:p + k - 1], ' ') g from (select item_id, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) p from iw where len(w) > 0)),
ks as (select distinct k from ig),
dp as (select rid, doc_id, w, k, unnest(range(1, len(w) - k + 2)) p from dw, ks where len(w) >= k),
hit as (select rid, p, dp.k, item_id from dp join ig on ig.k = dp.k and ig.g = array_to_string(w[p:p + dp.k - 1], ' ')),
pos as (select rid, count(distinct q) n_hit from (select rid, unnest(range(p, p + k)) q from hit) group by rid),
its as (select rid, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) s from hit group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join pos using (rid) left join its using (rid)
"""
