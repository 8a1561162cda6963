"""Periodic runs in texts: stretches of consecutive words that repeat with a period.

A run is a stretch of words with smallest period q, of at least max(``least``, ``times`` * q) words, that no neighbouring word
extends keeping period q. A diagonal is a lag q with the count of consecutive words that equal the word q places before; a
diagonal that ends at word e after M matches is a stretch of M + q words with period q.

Words are taken from left to right, and earlier occurrences of what ends at a word lengthen the diagonals of their lags; where
the next word does not lengthen a diagonal it ends, and is a run at once if it is long enough. All earlier occurrences of single
words would be squared in a text that repeats one word, so occurrences are thinned without loss: lags in (k/2, k] are
lengthened by the blocks of k words (k = 1, 2, 4, ...) that end at a word, and of those only by the latest earlier one. Within a
run of smallest period q <= k a block of k words recurs after exactly q words and no sooner (else a rotation of the period would
equal it and the period were not the smallest), so the diagonal of every run is met, from its k-th match on, and those of
multiples of q are not. Blocks of 2k words are pairs of blocks of k words that both recur in the same text: ordinary prose has
few of those, and the work stays near one sort of the words, and is n log n for any text. The steps of one slice of texts are
done together, on arrays.

Defined cases: null and empty texts have no words and no runs; white space (\\x20, \\x09-\\x0D) separates words; texts of any
length are taken whole; repeated rows are judged one by one; of runs that overlap all are listed, by start and period; empty
tables have no rows. Extra columns pass through under whatever names; those named like a result are replaced.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import SPACE_RUN, let, table, trimmed

#: Words of a run at least, and periods.
LEAST, TIMES = 6, 4

_RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
_RUNS = T.ArrayType(_RUN, False)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def diagonals(end: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place and lag of each diagonal: places that follow each other with the same lag (places ascend)."""
    cut = np.flatnonzero((np.diff(end) != 1) | (np.diff(lag) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(end)] - 1
    return end[first], end[last], lag[first]


def runs_of(words: np.ndarray, lengths: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) by start and period of the runs of texts that stand one after the other.

    words: a number for each word; lengths: how many words each text has; starts count from the first word of all. times is at
    least 2, else blocks of the period's size need not recur.
    """
    if times < 2:
        raise ValueError("a run has at least two periods")
    found = [np.zeros((0, 3), np.int64)]
    place = np.arange(len(words))
    # A text's words are told from those of other texts, so that no block recurs elsewhere.
    key = np.repeat(np.arange(len(lengths)), lengths) * (int(words.max(initial=0)) + 1) + words
    block = np.full(len(words), -1, np.int64)
    k, longest = 1, int(lengths.max(initial=0))
    while len(place) and times * (k // 2 + 1) <= longest:
        order = np.argsort(key, kind="stable")
        same = np.diff(key[order]) == 0
        lag = np.diff(place[order])
        met = np.flatnonzero(same & (lag > k // 2) & (lag <= k))
        if len(met):
            end = place[order[met + 1]]
            ascending = np.argsort(end, kind="stable")
            first, last, period = diagonals(end[ascending], lag[met][ascending])
            start = first - (k - 1) - period
            length = last - start + 1
            enough = length >= np.maximum(least, times * period)
            found.append(np.stack([start, length, period], 1)[enough])
        again = np.r_[same, False] | np.r_[False, same]
        names = np.cumsum(np.r_[True, ~same])[again]
        at = place[order[again]]
        block[at] = names
        after = np.sort(at[at >= k])
        place = after[block[after - k] >= 0]
        key = block[place - k] * (int(names.max(initial=0)) + 1) + block[place]
        block[at] = -1
        k *= 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words without those that a run has after its first period; runs: (start, length, period) within the text."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)])


def find_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str | None = None, least: int = LEAST, times: int = TIMES, keep: bool = True) -> DataFrame:
    """docs with the runs of every whole text: array of (start, length, period), starts in words from 0.

    collapsed names a column for the words that are left, in single spaces, where every run keeps its first period only;
    keep=False leaves the text out.
    """
    gone = {n.lower() for n in (runs, collapsed) if n} - {text.lower()}
    fields = [f for f in docs.schema.fields if f.name.lower() not in gone and (keep or f.name != text)]
    schema = T.StructType([*fields, T.StructField(runs, _RUNS), *([T.StructField(collapsed, T.StringType())] if collapsed else [])])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                numbers = _Numbers()
                split = [t.encode("utf-8", "replace").split() if t else [] for t in part.column(text).to_pylist()]
                lengths = np.array([len(w) for w in split], np.int64)
                flat = np.fromiter((n for w in split for n in map(numbers.__getitem__, w)), np.int64, int(lengths.sum()))
                rows = runs_of(flat, lengths, least, times)
                begins = np.cumsum(lengths) - lengths
                bounds = np.searchsorted(rows[:, 0], np.r_[begins, lengths.sum()])
                rows[:, 0] -= np.repeat(begins, np.diff(bounds))
                values = pa.StructArray.from_arrays([pa.array(rows[:, i].copy()) for i in range(3)], fields=[pa.field(n, pa.int64(), False) for n in _RUN.names])
                out = [*(part.column(f.name) for f in fields), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)]
                if collapsed:
                    out.append(pa.array([_collapsed(w, rows[a:b]).decode("utf-8") for w, a, b in zip(split, bounds[:-1], bounds[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.mapInArrow(trimmed(run), schema)


def looped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the words of every tenth text (by its id's crc32) replaced from some place on by a repeated part of themselves."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)

    def again(words):
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    words = F.filter(F.split(text, SPACE_RUN), lambda w: w != "")
    some = (h % 10 == 0) & F.col(text).rlike(r"[^\x20\x09-\x0D]")
    return docs.select(*[F.when(some, let(words, again)).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns])


def op13(spark, sf_dir: str) -> DataFrame:
    """find_runs() of all documents, with loops in every tenth, as the contract's columns."""
    docs = looped(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = find_runs(docs, collapsed="collapsed", keep=False)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    step = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    b = F.col("best")
    return step.select(
        "doc_id", "n_runs", (-b["start"]).alias("start"), b["length"].alias("length"), (-b["period"]).alias("period"),
        F.floor(1000 * b["length"] / -b["period"]).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


ORACLE = r"""
with c as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda t, i: xor(t >> 1, (t & 1) * 3988292384))), 4294967295) h from documents),
p as (select *, len(w) n, (h // 10) % greatest(len(w), 1) a, h // 10 g from c),
d as (select rid, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] end) else w end w from p),
o as (select rid, n, unnest(w) x, unnest(range(n)) i from d),
m as (select a.rid, b.i, b.i - a.i q from o a join o b on a.rid = b.rid and a.x = b.x and b.i > a.i and 4 * (b.i - a.i) <= a.n),
s as (select *, i - row_number() over (partition by rid, q order by i) k from m),
u as (select rid, q, min(i) - q st, count(*) + q le from s group by rid, q, k having count(*) + q >= greatest(6, 4 * q)),
r as (select rid, st, le, min(q) q from u group by rid, st, le),
t as (select rid, count(*) n_runs, max_by(struct_pack(st, le, q), struct_pack(a := le, b := -st, c := -q)) b, string_agg(st || ',' || le || ',' || q || chr(10), '' order by st, q) runs from r group by rid),
z as (select distinct rid, unnest(range(st + q, st + le)) i from r),
k as (select rid, string_agg(x, ' ' order by i) kept from o anti join z using (rid, i) group by rid)
select doc_id, coalesce(n_runs, 0) n_runs, b.st "start", b.le length, b.q period, 1000 * b.le // b.q exponent_milli, sha256(coalesce(runs, '')) runs_sha256, sha256(coalesce(kept, '')) collapsed_sha256
from d left join t using (rid) left join k using (rid)
"""
