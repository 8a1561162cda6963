"""Ranked lexical search with the Best Position Algorithm.

A-Z are lower-cased; terms are runs of digits, a-z and characters beyond ASCII. A term's weight comes from its document
frequency, its impact in a document from that weight, the term's occurrences and the document's length, all in 64-bit integers;
a document's score for an item is the sum of the impacts of the item's different terms.

Documents stay where they are. One pass counts documents, terms and the document frequencies of the items' terms. In a second
one every task indexes its documents in blocks of a bounded number of words: for each of the items' terms a list of documents in
descending order of impact, and for direct accesses the impacts and places of every document. Each item reads its lists side by
side. A document that comes up is looked up in all of them (direct accesses), which also marks its places as seen; the best
position of a list is the end of the seen places that follow each other from its beginning. No document that did not come up
scores more than the sum of the impacts at the best positions, and reading stops as soon as that is strictly below the k-th
score, so equal scores are never missed. The k best of a task's earlier blocks count, too: a block whose first impacts do not
reach them is not read at all. Each task hands on k documents an item; a window ranks those.

Items go out in groups whose terms take at most ``max_bytes`` in a broadcast (64 bytes a term beside its own; one item is never
split); more items mean more passes, with the same rows.

Defined cases: null texts and texts without terms match nothing, and items like that get no rows; repeated items are ranked once
and each gets its rows; repeated documents are ranked one by one; equal scores go by ascending id, null ids last; very long texts are
indexed whole; empty tables give no rows. Other columns of both tables are left out of the result.
"""

from functools import reduce
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import table, trimmed
from .decontam import words_of

K = 10
#: Bytes that the terms of one group of items take in a broadcast at most.
MAX_BYTES = 32_000_000
#: Bytes of text that are indexed at a time; a longer text is a block of its own.
BLOCK_BYTES = 12_000_000
#: Places of each list that are read first; each further time twice as many.
FIRST_READ = 8

_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Impacts before the weight are below this: 10^9 tf div (10^3 tf + 8 m) with m > 0.
_MOST = 1 << 20


def terms_of(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAP), lambda w: w != ""))


def weight(n: int, df: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


class Postings:
    """How often the known terms occur in some texts, document by document."""

    def __init__(self, texts: list, number: dict[bytes, int]) -> None:
        self.docs, self.known = len(texts), len(number)
        self.lengths = np.zeros(len(texts), np.int64)
        found = []
        for i, t in enumerate(texts):
            words = words_of(t)
            self.lengths[i] = len(words)
            ids = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
            found.append(ids[ids >= 0] + i * self.known)
        keys, self.tf = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        self.doc, self.term = np.divmod(keys, max(1, self.known))


class Impacts:
    """Impact lists of the known terms over some documents, with direct access by document."""

    def __init__(self, p: Postings, weights: np.ndarray, n: int, total: int) -> None:
        m = 10 + (90 * p.lengths[p.doc] * n) // total
        part = (1_000_000_000 * p.tf) // (1000 * p.tf + 8 * m)
        self.docs, self.doc, self.term, self.impact = p.docs, p.doc, p.term, weights[p.term] * part
        self.begin = np.searchsorted(p.doc, np.arange(p.docs + 1))
        self.by_impact = np.argsort(p.term * _MOST + (_MOST - 1 - part), kind="stable")
        self.start = np.searchsorted(p.term[self.by_impact], np.arange(p.known + 1))
        self.place = np.empty(len(p.term), np.int64)
        self.place[self.by_impact] = np.arange(len(p.term)) - self.start[p.term[self.by_impact]]


class Best:
    """The k best documents of one item so far: scores, ids and whether an id is null."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        some = score > 0 if len(self.score) < self.k else score >= self.score[-1]
        score, ids, null = (np.r_[a, b[some]] for a, b in ((self.score, score), (self.id, ids), (self.null, null)))
        first = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[first], ids[first], null[first]

    def above(self, bound: int) -> bool:
        """Whether the k-th score is strictly above what any other document can have."""
        return len(self.score) == self.k and self.score[-1] > bound


def best_positions(x: Impacts, terms: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best, number: np.ndarray, first: int = FIRST_READ) -> int:
    """Adds an item's best documents of the block to best; number: scratch of -1 for each term. Returns how many documents came up."""
    terms = terms[x.start[terms + 1] > x.start[terms]]
    start, length = x.start[terms], x.start[terms + 1] - x.start[terms]
    if not len(terms):
        return 0
    offset = np.cumsum(length) - length
    seen = np.zeros(int(length.sum()), bool)
    scored = np.zeros(x.docs, bool)
    at = np.zeros(len(terms), np.int64)  # places seen without a gap
    number[terms] = np.arange(len(terms))
    depth, step, looked = 0, first, 0
    while True:
        bound = np.where(at < length, x.impact[x.by_impact[start + np.maximum(at - 1, 0)]], 0).sum()
        if (at == length).all() or best.above(bound):
            break
        places = depth + np.arange(step)
        read = places < length[:, None]
        seen[(offset[:, None] + places)[read]] = True
        docs = x.doc[x.by_impact[(start[:, None] + places)[read]]]
        new = np.unique(docs[~scored[docs]])
        scored[new] = True
        looked += len(new)
        count = x.begin[new + 1] - x.begin[new]
        entries = np.arange(count.sum()) + np.repeat(x.begin[new] - (np.cumsum(count) - count), count)
        which = number[x.term[entries]]
        entries, owner, which = entries[which >= 0], np.repeat(np.arange(len(new)), count)[which >= 0], which[which >= 0]
        seen[offset[which] + x.place[entries]] = True
        # Sums of integers below 2^53 are exact in doubles.
        best.add(np.bincount(owner, x.impact[entries], len(new)).astype(np.int64), ids[new], null[new])
        for i in range(len(terms)):
            rest = seen[offset[i] + at[i] : offset[i] + length[i]]
            at[i] += len(rest) if rest.all() else int(rest.argmin())
        depth, step = depth + step, 2 * step
    number[terms] = -1
    return looked


def _statistics(docs: DataFrame, text: str, number) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and the document frequency of each known term."""

    def run(batches):
        df, n, total = np.zeros(len(number.value), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, text, BLOCK_BYTES):
                p = Postings(part.column(text).to_pylist(), number.value)
                df += np.bincount(p.term, minlength=len(df))
                n, total = n + int((p.lengths > 0).sum()), total + int(p.lengths.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, some]), pa.array(np.r_[n, total, df[some]])], names=["term", "n"])

    counts = docs.select(text).mapInArrow(trimmed(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in counts.collect()}  # no more rows than known terms and two
    return found.pop(-2, 0), found.pop(-1, 0), found


def _groups(items: DataFrame, max_bytes: int) -> list[DataFrame]:
    """Different items (id, terms, copies) in groups of bounded size; a group may be larger only where one item is."""
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda s, w: s + F.octet_length(w) + 64)
    rows, n = items.where(F.size("terms") > 0).groupBy("id", "terms").agg(F.count("*").alias("copies")), 1
    while True:
        group = F.pmod(F.xxhash64("id", "terms"), F.lit(n))
        most = rows.groupBy(group.alias("g")).agg(F.sum(size).alias("bytes"), F.count("*").alias("items")).where((F.col("bytes") > max_bytes) & (F.col("items") > 1))
        if most.isEmpty():
            return [rows] if n == 1 else [rows.where(group == g) for g in range(n)]
        n *= 2


def _searched(docs: DataFrame, items: DataFrame, text: str, doc_id: str, k: int) -> DataFrame:
    """The k best documents of each task for each item of one group: (item, item_id, copies, doc_id, score)."""
    spark = docs.sparkSession
    asked = [(r.id, r.copies, [w.encode() for w in r.terms]) for r in items.collect()]  # bounded by max_bytes
    number = {w: i for i, w in enumerate(sorted({w for *_, terms in asked for w in terms}))}
    known = spark.sparkContext.broadcast(number)
    n, total, df = _statistics(docs, text, known)
    weights = np.array([weight(n, df.get(t, 0)) for t in range(len(number))], np.int64)
    lists = [np.array([t for w in terms if weights[t := number[w]] > 0], np.int64) for *_, terms in asked]
    query = spark.sparkContext.broadcast((weights, lists, [(i, c) for i, c, _ in asked]))
    kind = "item int, item_id long, copies long, doc_id long, score long"

    def run(batches):
        weights, lists, heads = query.value
        best, scratch = [Best(k) for _ in lists], np.full(len(weights), -1, np.int64)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                x = Impacts(Postings(part.column("text").to_pylist(), known.value), weights, n, total)
                ids = part.column("doc_id")
                values, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
                for terms, b in zip(lists, best, strict=True):
                    best_positions(x, terms, values, null, b, scratch)
        which = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
        joined = lambda name, kind: np.concatenate([getattr(b, name) for b in best]) if best else np.zeros(0, kind)
        columns = [pa.array(which, pa.int32()), *(pa.array([heads[i][j] for i in which], pa.int64()) for j in (0, 1)), pa.array(joined("id", np.int64), pa.int64(), mask=joined("null", bool)), pa.array(joined("score", np.int64), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "copies", "doc_id", "score"])

    if not total:
        return spark.createDataFrame([], kind)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), kind)


def ranked_search(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", k: int = K, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    asked = items.select(F.col(item_id).cast("long").alias("id"), terms_of(F.col(item_text)).alias("terms"))
    parts = [_searched(docs, g, text, doc_id, k).withColumn("part", F.lit(i)) for i, g in enumerate(_groups(asked, max_bytes))]
    order = Window.partitionBy("part", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order))
    top = ranked.where(F.col("rank") <= k).select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return top.select("item_id", "rank", "doc_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE = r"""
with d as (select doc_id, row_number() over () rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
s as (select cast(count(*) as bigint) n, cast(sum(len(w)) as bigint) l from d where len(w) > 0),
q as (select qid, item_id, unnest(list_distinct(w)) t from (select row_number() over () qid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w from benchmark)),
f as (select rid, t, count(*) tf from (select rid, unnest(w) t from d) where t in (select t from q) group by rid, t),
g as (select t, count(*) df from f group by t),
i as (select rid, f.t, cast(floor(1000 * ln(cast(2 * n + 2 as double) / cast(2 * df + 1 as double))) as bigint) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(w) * n) // l))) x from f join g using (t) join d using (rid), s),
r as (select qid, item_id, rid, cast(sum(x) as bigint) score from q join i using (t) group by qid, item_id, rid having sum(x) > 0),
o as (select item_id, cast(row_number() over (partition by qid order by score desc, doc_id) as integer) rank, doc_id, score from r join d using (rid))
select item_id, rank, doc_id, score from o where rank <= 10
"""
