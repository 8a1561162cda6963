"""N-gram Jaccard join: documents whose sets of word shingles are at least 80 % alike, and their components.

A-Z are lower-cased; words are runs of other characters than space and \\t-\\r. A document's set has its distinct 5-word
shingles (64-bit hashes); with fewer words the whole sequence is one shingle; without words the set is empty and linked with
nothing. Two documents link when 100 * |A & B| >= 80 * |A | B|.

The plan, in which no step holds all pairs or an unbounded group:

1. One scan gives each document its set's identity and count vector (shingles hashed into groups), and the corpus a bounded
   sketch of how frequent shingles are. Documents with equal sets are one class from here on.
2. Linked sets share one of the first n - ceil(0.8 n) + 1 shingles in any common order; rare ones go first, so a passage
   that many documents share makes no crowd. Classes that share such a shingle form a crowd, unless their sizes and the places
   of the shingle in their orders leave no room for the overlap.
3. In each crowd and size class all are compared with its first class (a linear number of pairs): the coordinate minima of
   the count vectors bound the overlap, what survives is verified on the shingles, and what links makes components.
4. Crowds that still hold several components are packed into R-trees of count vectors (large ones as pairs of blocks). A join
   of the trees finds the pairs of different components whose summed coordinate minima can reach the overlap. Where these are
   few, they are verified as pairs; where they are more than twice the members, the block's members are sent with their texts
   to one task, which verifies there and hands on no more links than it has members. The components of all verified links
   are the result, the same as that of all links.

Count vectors alone can't route the join at scale: random sets of one size lie closer together than the radius of the search,
so a tree over all documents would visit all pairs. Step 2 therefore deals out documents first, without losing a link.

Defined cases: null texts are empty; repeated rows and copies are members of one class; a null id never is a component's id,
unless the component has no other; very long texts take part whole, and sizes beyond 2^23 shingles are compared by their exact
overlap only; empty tables have no rows. Columns other than the id and the text pass through keep_one() under whatever names.
"""

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, free_name, table, trimmed
from .components import components

WORDS = 5
SIMILARITY = (80, 100)
#: Cells of the frequency sketch and of the filter of wanted classes: bounds of what is broadcast.
SKETCH = 1 << 20
FILTER_BITS = 1 << 27
#: Members of a crowd that one task takes at a time, and points in a node of the tree.
BLOCK = 256
NODE = 16
#: Rows of one key that are looked at together; a key with more passes on in pieces of that many, without the filter by places.
CARRY = 1 << 16
_CHUNK = 1 << 12
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(WORDS, 0x9E3779B97F4A7C15, np.uint64)], dtype=np.uint64)
_SIZE_BITS = 23
_SIZE_SHIFT = 63 - _SIZE_BITS


def mixed(x: np.ndarray) -> np.ndarray:
    for m in _MIX:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _hashes() -> _WordHashes:
    return _WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += h[k : k + n] * _POWERS[k + 1]
    return np.unique(mixed(total))


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two longs that stand for a set: 64 bits of a digest; the size (as far as 23 bits go) and 40 more bits."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    a = int.from_bytes(d[:8], "little", signed=True)
    b = min(len(s), (1 << _SIZE_BITS) - 1) << _SIZE_SHIFT | int.from_bytes(d[8:], "little") >> (64 - _SIZE_SHIFT)
    return a, b


def groups_for(n: int) -> int:
    return 1 << min(12, max(4, (max(1, n) // 4).bit_length()))


def count_vector(s: np.ndarray) -> bytes:
    """Shingles in each group (by the leading bits of the hash), 8 bits each; groups grow with the size."""
    g = groups_for(len(s))
    counts = np.bincount((s >> np.uint64(64 - g.bit_length() + 1)).astype(np.int64), minlength=g)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def needed(na, nb):
    """The least overlap of two linked sets: inter * (100 + 80) >= 80 * (na + nb)."""
    p, q = SIMILARITY
    return -(-p * (na + nb) // (p + q))


def folded(v: np.ndarray, g: int) -> np.ndarray:
    """Rows of count vectors with neighbouring groups added up to g groups; never less than the true count (255 stays open)."""
    v = v.astype(np.int32)
    v[v == 255] = 1 << 24
    return v.reshape(len(v), g, -1).sum(2, dtype=np.int32) if g < v.shape[1] else v


def _packed(x: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned type that holds them; the length tells which."""
    return x.astype(f"<u{next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << (8 * w))}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // _CHUNK}")


def _partial_sums(counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    parts = counts.reshape(-1, _CHUNK)
    used = np.flatnonzero(parts.any(1))
    return used.tolist(), [_packed(parts[i]) for i in used]


def _reduced(parts: DataFrame, cells: int, how) -> np.ndarray:
    """Rows (chunk, counts) of partial arrays joined into one array of bounded size."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _unpacked(data)
                sums[c] = how(sums[c], x, dtype=np.uint64) if c in sums else x.astype(np.uint64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros(cells, np.uint64)
    for r in parts.repartition("chunk").mapInArrow(trimmed(run), "chunk int, counts binary").collect():
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = _unpacked(r["counts"])
    return out


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text) to rows of documents (doc_id, th, n, a, b, vec) and rows of the sketch (chunk, counts)."""
    kind = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("vec", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        sketch = np.zeros(SKETCH, np.int64)

        def count(sets: list) -> None:
            if sets:
                sketch[:] += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)

        for batch in batches:
            ns, ids, vecs, sets, held = [], [], [], [], 0
            for value in batch.column("text"):
                s = shingles(value.as_py(), words)
                ns.append(len(s))
                ids.append(identity(s))
                vecs.append(count_vector(s))
                sets.append(s)
                held += len(s)
                if held > 1_000_000:
                    count(sets)
                    sets, held = [], 0
            count(sets)
            n = len(ns)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(ns, pa.int64()), pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int64()), pa.array(vecs, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                schema=kind,
            )
        used, parts = _partial_sums(sketch)
        if used:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(used), f.type) for f in list(kind)[:6]), pa.array(used, pa.int32()), pa.array(parts, pa.binary())], schema=kind)
        _hashes().clear()

    return docs.mapInArrow(trimmed(run), "doc_id long, th long, n long, a long, b long, vec binary, chunk int, counts binary")


def _once(seen: set, key: tuple) -> bool:
    """Whether a task meets a class for the first time (as far as a bounded memory tells; more is only more rows)."""
    if key in seen:
        return False
    if len(seen) > 500_000:
        seen.clear()
    seen.add(key)
    return True


def _prefix_rows(docs: DataFrame, sketch, words: int) -> DataFrame:
    """(key, a, b, place): the rarest n - ceil(0.8 n) + 1 shingles of each class with their places in its order, once a task."""
    p, q = SIMILARITY

    def run(batches):
        counts, seen = sketch.value, set()
        for batch in batches:
            keys, a, b, places = [], [], [], []
            for value in batch.column("text"):
                s = shingles(value.as_py(), words)
                if not len(s):
                    continue
                who = identity(s)
                if not _once(seen, who):
                    continue
                first = np.argsort(counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")[: len(s) - -(-p * len(s) // q) + 1]
                keys.append(s[first])
                a.append(np.full(len(first), who[0], np.int64))
                b.append(np.full(len(first), who[1], np.int64))
                places.append(np.arange(len(first), dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (a, b, places))], names=["key", "a", "b", "place"])
        _hashes().clear()

    return docs.mapInArrow(trimmed(run), "key long, a long, b long, place int")


def _size(b: np.ndarray) -> np.ndarray:
    return b >> _SIZE_SHIFT


def _size_class(b: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(_size(b), 1)) / math.log(1.25) + 1e-9).astype(np.int64)


def _with_partners(k, b, place, open_first: bool, open_last: bool) -> np.ndarray:
    """Whether a row's key has another row of a size that it can link with, as far as sizes and the row's own place tell.

    The first common shingle of two linked sets leaves room for the overlap: need(na, nb) <= n - place on both sides.
    """
    p, q = SIMILARITY
    wide, top = 1 << (_SIZE_BITS + 1), (1 << _SIZE_BITS) - 1
    g, s = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1, _size(b)
    low, high = -(-p * s // q), np.minimum(q * s // p, ((p + q) * (s - place) - p * s) // p)
    low, high = np.minimum(low, top), np.where(s == top, wide - 1, np.clip(high, 0, wide - 1))
    at = g * wide + s
    found = np.searchsorted(at, g * wide + high, "right") - np.searchsorted(at, g * wide + low, "left")
    keep = found - ((low <= s) & (s <= high)) > 0
    if open_first:
        keep |= g == 0
    if open_last:
        keep |= g == g[-1]
    return keep


def _crowds(rows: DataFrame) -> DataFrame:
    """Rows of keys with at least two classes that can link, each with the first class of its key and size class (ca, cb).

    Of a key with two classes the second is compared with the first, whatever their size classes.
    """

    def run(batches):
        held, head, open_first = None, None, False  # rows of the last key; (key, size class, ca, cb) of a key that goes on

        def crowd(k, a, b, place, open_last):
            nonlocal head
            new = np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            k, a, b, place = k[new], a[new], b[new], place[new]
            keep = _with_partners(k, b, place, open_first, open_last)
            k, a, b = k[keep], a[keep], b[keep]
            if not len(k):
                return None
            start = np.r_[True, k[1:] != k[:-1]]
            n = np.diff(np.r_[np.flatnonzero(start), len(k)])[np.cumsum(start) - 1]
            ends = (k == k[0]) & open_first | (k == k[-1]) & open_last
            keep = (n > 1) | ends
            k, a, b, n, ends = k[keep], a[keep], b[keep], n[keep], ends[keep]
            if not len(k):
                return None
            sc = _size_class(b)
            same = np.r_[False, k[1:] == k[:-1]]
            first = ~same | (np.r_[True, sc[1:] != sc[:-1]] & ((n > 2) | ends))
            at = np.maximum.accumulate(np.where(first, np.arange(len(k)), 0))
            ca, cb = a[at], b[at]
            if head is not None:
                on = (k == head[0]) & (sc == head[1])
                ca, cb = np.where(on, head[2], ca), np.where(on, head[3], cb)
            head = (k[-1], sc[-1], ca[-1], cb[-1]) if open_last else None
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (k, a, b, ca, cb)], names=["key", "a", "b", "ca", "cb"])

        for batch in batches:
            rows_ = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                rows_ = [np.concatenate(x) for x in zip(held, rows_, strict=True)]
            cut = int(np.searchsorted(rows_[0], rows_[0][-1], "left"))
            hot = len(rows_[0]) - cut > CARRY
            if hot:
                cut = len(rows_[0])
            if cut:
                out = crowd(*(x[:cut] for x in rows_), hot)
                open_first = hot
                if out is not None:
                    yield out
            held = None if hot else [x[cut:] for x in rows_]
        if held is not None and len(held[0]) and (out := crowd(*held, False)) is not None:
            yield out

    return rows.repartition("key").sortWithinPartitions("key", "b", "a").mapInArrow(trimmed(run), "key long, a long, b long, ca long, cb long")


def _bounded(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pairs (a, b, ca, cb) whose summed coordinate minima reach the overlap that a link needs."""
    v = vectors.select("a", "b", "vec")
    c = vectors.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("vec").alias("cvec"))

    def run(batches):
        for batch in batches:
            a, b, ca, cb = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("a", "b", "ca", "cb"))
            need, ok = needed(_size(b), _size(cb)), np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(batch.column("vec").to_pylist(), batch.column("cvec").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                g = min(len(x), len(y))
                ok[i] = np.minimum(folded(x[None], g), folded(y[None], g)).sum(dtype=np.int64) >= need[i]
            yield pa.RecordBatch.from_arrays([pa.array(z[ok]) for z in (a, b, ca, cb)], names=["a", "b", "ca", "cb"])

    return pairs.join(v, ["a", "b"]).join(c, ["ca", "cb"]).select("a", "b", "ca", "cb", "vec", "cvec").mapInArrow(trimmed(run), "a long, b long, ca long, cb long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Pairs whose shingles are alike as asked; texts: one text a class. A class in many pairs is compared with blocks of them."""
    t = texts.select("a", "b", "text")
    c = texts.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("text").alias("ctext"))
    p, q = SIMILARITY

    def run(batches):
        kept: dict[tuple, np.ndarray] = {}

        def known(a, b, text):
            if (a, b) not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[a, b] = shingles(text, words)
            return kept[a, b]

        for batch in batches:
            out = []
            for a, b, ca, cb, i in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "ca", "cb")), range(batch.num_rows), strict=True):
                center = known(ca, cb, batch.column("ctext")[i].as_py())
                mine = shingles(batch.column("text")[i].as_py(), words)
                inter = len(np.intersect1d(center, mine, assume_unique=True))
                if q * inter >= p * (len(center) + len(mine) - inter):
                    out.append((a, b, ca, cb))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["a", "b", "ca", "cb"])
        _hashes().clear()

    return pairs.join(c, ["ca", "cb"]).join(t, ["a", "b"]).select("a", "b", "ca", "cb", "text", "ctext").mapInArrow(trimmed(run), "a long, b long, ca long, cb long")


class RTree:
    """Points (size, count vector) packed bottom up: sorted by size, tiles of similar vectors, NODE entries a node.

    A node keeps the largest coordinate of each group and the range of sizes below it.
    """

    def __init__(self, sizes: np.ndarray, vectors: np.ndarray) -> None:
        order = np.lexsort((vectors[:, 1 % vectors.shape[1]], vectors[:, 0], sizes // max(1, int(sizes.max()) // 16)))
        self.order, self.sizes, self.vectors = order, sizes[order], vectors[order]
        self.levels = [(self.vectors, self.sizes, self.sizes)]
        while len(self.levels[-1][0]) > 1:
            high, low_n, high_n = self.levels[-1]
            cuts = np.arange(0, len(high), NODE)
            self.levels.append((np.maximum.reduceat(high, cuts), np.minimum.reduceat(low_n, cuts), np.maximum.reduceat(high_n, cuts)))

    def pairs(self, other: "RTree"):
        """(own point, other's point) where sizes and summed coordinate minima allow a link; arrays of original numbers."""
        depth = max(len(self.levels), len(other.levels))
        left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for level in range(depth - 1, -1, -1):
            mine, theirs = self.levels[min(level, len(self.levels) - 1)], other.levels[min(level, len(other.levels) - 1)]
            if level < depth - 1:
                left, right = _children(left, right, len(mine[0]) if level < len(self.levels) - 1 else None, len(theirs[0]) if level < len(other.levels) - 1 else None)
            keep = np.zeros(len(left), bool)
            step = max(64, (1 << 21) // self.vectors.shape[1])
            for at in range(0, len(left), step):
                l, r = left[at : at + step], right[at : at + step]
                p, q = SIMILARITY
                fits = (q * mine[2][l] >= p * theirs[1][r]) & (q * theirs[2][r] >= p * mine[1][l])
                bound = np.minimum(mine[0][l], theirs[0][r]).sum(1, dtype=np.int64)
                keep[at : at + step] = fits & (bound >= needed(mine[1][l], theirs[1][r]))
            left, right = left[keep], right[keep]
        return self.order[left], other.order[right]


def _children(left, right, n_left, n_right):
    """Pairs of children of the pairs of nodes (None: that side is at its points already)."""
    one = lambda x, n: (x[:, None] * NODE + np.arange(NODE)) if n is not None else x[:, None]
    l, r = one(left, n_left), one(right, n_right)
    pl, pr = np.repeat(l, r.shape[1], axis=1).ravel(), np.tile(r, (1, l.shape[1])).ravel()
    ok = np.ones(len(pl), bool)
    if n_left is not None:
        ok &= pl < n_left
    if n_right is not None:
        ok &= pr < n_right
    return pl[ok], pr[ok]


def _let_through(b: np.ndarray, comp: np.ndarray, block: np.ndarray, vecs: list) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of different components (and blocks, where there are two) that the trees let through."""
    p, q = SIMILARITY
    sizes, two = _size(b), bool((block != block[0]).any())
    if len(b) <= NODE:  # one node: its points are compared at once
        left, right = [], []
        for i in range(len(b) - 1):
            r = slice(i + 1, None)
            fits = (comp[r] != comp[i]) & (q * sizes[r] >= p * sizes[i]) & (q * sizes[i] >= p * sizes[r]) & ((block[r] != block[i]) | (not two))
            for j in (np.flatnonzero(fits) + i + 1).tolist():
                g = min(len(vecs[i]), len(vecs[j]))
                if np.minimum(folded(vecs[i][None], g), folded(vecs[j][None], g)).sum(dtype=np.int64) >= needed(sizes[i], sizes[j]):
                    left.append(i)
                    right.append(j)
        return np.array(left, np.int64), np.array(right, np.int64)
    classes, found = _size_class(b), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for sc in np.unique(classes):
        # a link never reaches beyond the next two classes of sizes
        own = np.flatnonzero(classes == sc)
        for there in (sc, sc + 1, sc + 2):
            others = np.flatnonzero(classes == there)
            if not len(others):
                continue
            g = min(min(len(vecs[i]) for i in own), min(len(vecs[i]) for i in others))
            pack = lambda at: RTree(sizes[at], np.vstack([folded(vecs[i][None], g)[0] for i in at]))  # noqa: B023, E731
            l, r = pack(own).pairs(pack(others))
            l, r = own[l], others[r]
            ok = (comp[l] != comp[r]) & ((l < r) if there == sc else True) & ((block[l] != block[r]) | (not two))
            found.append((l[ok], r[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _grouped(batches, names: tuple[str, ...]):
    """Rows of a sorted stream of batches as lists of columns, one for each (crowd, i, j)."""
    held, rows = None, []
    for batch in batches:
        for crowd, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("crowd", "i", "j", *names)), strict=True):
            if (crowd, i, j) != held:
                if len(rows) > 1:
                    yield held, list(zip(*rows, strict=True))
                held, rows = (crowd, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield held, list(zip(*rows, strict=True))


def _numbered(ra, rb) -> np.ndarray:
    roots: dict = {}
    return np.array([roots.setdefault(r, len(roots)) for r in zip(ra, rb, strict=True)])


def _tree_rows(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Blocks of crowds to the pairs that the trees let through (a, b, ca, cb); or, where these are more than twice the members,
    to the members that stand in any of them (a, b, ra, rb, crowd, i, j)."""
    rows = members.join(vectors.select("a", "b", "vec"), ["a", "b"])
    kind = pa.schema([(c, pa.int64()) for c in ("a", "b", "ca", "cb", "ra", "rb", "crowd")] + [("i", pa.int32()), ("j", pa.int32())])

    def run(batches):
        for (crowd, i, j), (a, b, ra, rb, block, vecs) in _grouped(batches, ("a", "b", "ra", "rb", "block", "vec")):
            a, b, ra, rb = (np.array(x, np.int64) for x in (a, b, ra, rb))
            l, r = _let_through(b, _numbered(ra.tolist(), rb.tolist()), np.array(block), [np.frombuffer(v, np.uint8) for v in vecs])
            if not len(l):
                continue
            if len(l) > 2 * len(a):
                at = np.unique(np.r_[l, r])
                cols, tail = [a[at], b[at], None, None, ra[at], rb[at]], (crowd, i, j)
            else:
                swap = (b[l] > b[r]) | ((b[l] == b[r]) & (a[l] > a[r]))
                l, r = np.where(swap, r, l), np.where(swap, l, r)
                cols, tail = [a[r], b[r], a[l], b[l], None, None], (None, None, None)
            n = len(cols[0])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in cols), *(pa.array([t] * n, kind.field(6 + m).type) for m, t in enumerate(tail))], schema=kind)

    dealt = rows.repartition("crowd", "i", "j").sortWithinPartitions("crowd", "i", "j", "a", "b")
    return dealt.select("crowd", "i", "j", "a", "b", "ra", "rb", "block", "vec").mapInArrow(trimmed(run), "a long, b long, ca long, cb long, ra long, rb long, crowd long, i int, j int")


def overlaps(sets: list) -> np.ndarray:
    """How many shingles each two of a block's sets share: products of incidence matrices, some thousand shingles at a time."""
    lengths = np.array([len(s) for s in sets])
    values, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    column = np.cumsum(n > 1) - 1  # shingles of one set alone count nowhere
    shared = (n > 1)[at]
    owner, column = owner[shared], column[at[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, width = np.zeros((len(sets), len(sets)), np.float64), 1 << 12
    for low in range(0, int((n > 1).sum()), width):
        own = slice(*np.searchsorted(column, (low, low + width)))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[own], column[own] - low] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _dense_links(dense: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Members of dense blocks, verified inside one task a block: at most one link for each component that joins another."""
    p, q = SIMILARITY
    rows = dense.join(texts.select("a", "b", "text"), ["a", "b"])

    def run(batches):
        for _, (a, b, ra, rb, found) in _grouped(batches, ("a", "b", "ra", "rb", "text")):
            comp = _numbered(ra, rb)
            sets = [shingles(t, words) for t in found]
            n, inter = np.array([len(s) for s in sets]), overlaps(sets)
            alike = (q * inter >= p * (n[:, None] + n[None] - inter)) & (comp[:, None] != comp[None])
            out = []
            for i in range(len(a)):
                while len(js := np.flatnonzero(alike[i] & (comp != comp[i]))):
                    j = int(js[0])
                    out.append((a[i], b[i], a[j], b[j]))
                    comp[comp == comp[j]] = comp[i]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["a", "b", "ca", "cb"])
        _hashes().clear()

    dealt = rows.repartition("crowd", "i", "j").sortWithinPartitions("crowd", "i", "j", "a", "b")
    return dealt.select("crowd", "i", "j", "a", "b", "ra", "rb", "text").mapInArrow(trimmed(run), "a long, b long, ca long, cb long")


def _mixed_crowds(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of crowds with several components, each crowd of the same members once, dealt into pairs of blocks.

    A crowd of two has been compared already.
    """
    known = roots.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.col("root.a").alias("ra"), F.col("root.b").alias("rb"))
    rows = crowds.select("key", "a", "b").join(known, ["a", "b"], "left").select("key", "a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    per_key = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"), F.min(F.struct("rb", "ra")).alias("lo"), F.max(F.struct("rb", "ra")).alias("hi"))
    several = per_key.where("n > 2 and lo != hi").groupBy("n", "sum").agg(F.min("key").alias("key"))
    mine = rows.join(several.select("key", "n"), "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("a", "b", F.lit(7)), blocks).cast("int")
    dealt = mine.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select(F.col("key").alias("crowd"), F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "a", "b", "ra", "rb")


def _wanted_texts(rows: DataFrame, wanted: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, text): one text for each class in wanted. A bounded filter keeps most other texts from being sent; the joins are exact."""
    wanted = scratch.saved(members.join(wanted.distinct(), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.min("th").alias("th")), "wanted")
    bits = min(FILTER_BITS, max(8 * _CHUNK, 1 << (16 * wanted.count()).bit_length()))

    def marks(batches):
        mine = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column("th").to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(bits)
            np.bitwise_or.at(mine, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        used, parts = _partial_sums(mine)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.binary())], names=["chunk", "counts"])

    marked = _reduced(wanted.select("th").mapInArrow(marks, "chunk int, counts binary"), bits // 8, np.bitwise_or).astype(np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(marked)

    def run(batches):
        mine, seen = shared.value, set()
        for batch in batches:
            th = batch.column("th").to_numpy(zero_copy_only=False)
            at = th.view(np.uint64) % np.uint64(bits)
            hit = (mine[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            first = [i for i in np.flatnonzero(hit).tolist() if _once(seen, (int(th[i]), 0))]
            yield batch.take(pa.array(first, pa.int64()))

    found = rows.select(F.xxhash64("text").alias("th"), "text").mapInArrow(trimmed(run), "th long, text string").join(wanted, "th")
    texts = scratch.saved(found.groupBy("a", "b").agg(F.first("text").alias("text")), "texts")
    shared.destroy()
    return texts


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.struct("b", "a").alias("u"), F.struct(F.col("cb").alias("b"), F.col("ca").alias("a")).alias("v"))


def _merged(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) once the components that the links tie are one."""
    root = F.coalesce(F.col("root"), F.col("x"))
    lift = lambda df, c: df.withColumnRenamed(c, "x").join(roots.withColumnRenamed("node", "x"), "x", "left").withColumn(c, root).drop("x", "root")
    tops = components(lift(lift(_links(links), "u"), "v"))
    whole = roots.withColumnRenamed("root", "mid").join(tops.select(F.col("node").alias("mid"), F.col("root").alias("top")), "mid", "left").select("node", F.coalesce("top", "mid").alias("root"))
    only = tops.join(roots.select("node"), "node", "left_anti").select("node", "root")
    return scratch.saved(whole.union(only), "roots")


def _rooted(docs: DataFrame, doc_id: str, text: str, words: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n, a, b) of every document, with a and b for its set of shingles, and (a, b, root) of every set with links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    profile = scratch.saved(_profile(rows.select("doc_id", "text", F.xxhash64("text").alias("th")), words), "profile")
    members = profile.where("chunk is null").select("doc_id", "th", "n", "a", "b")
    sketch = _reduced(profile.where("chunk is not null").select("chunk", "counts"), SKETCH, np.add)
    shared = spark.sparkContext.broadcast(np.minimum(sketch, (1 << 32) - 1).astype(np.uint32))
    crowds = scratch.saved(_crowds(_prefix_rows(rows.select("text"), shared, words)), "crowds")
    shared.destroy()

    p, q = SIMILARITY
    size, csize = F.shiftright("b", _SIZE_SHIFT), F.shiftright("cb", _SIZE_SHIFT)
    stars = crowds.where("a != ca or b != cb").where((q * size >= p * csize) & (q * csize >= p * size)).select("a", "b", "ca", "cb").distinct()
    vectors = profile.where("chunk is null and n > 0").select("a", "b", "vec").join(crowds.select("a", "b").distinct(), ["a", "b"], "left_semi")
    vectors = scratch.saved(vectors.groupBy("a", "b").agg(F.first("vec").alias("vec")), "vectors")
    ends = lambda pairs: pairs.select("a", "b").union(pairs.select("ca", "cb"))

    near = scratch.saved(_bounded(stars, vectors), "star-pairs")
    texts = _wanted_texts(rows, ends(near), members, scratch)
    roots = scratch.saved(components(_links(_verified(near, texts, words))), "roots")
    scratch.drop(texts, near)
    far = scratch.saved(_tree_rows(_mixed_crowds(crowds, roots), vectors), "tree-rows")
    scratch.drop(crowds, vectors)
    pairs, dense = far.where("crowd is null").select("a", "b", "ca", "cb").distinct(), far.where("crowd is not null").drop("ca", "cb")
    texts = _wanted_texts(rows, ends(pairs).union(dense.select("a", "b")), members, scratch)
    links = scratch.saved(_verified(pairs, texts, words).union(_dense_links(dense, texts, words)), "far-links")
    merged = _merged(roots, links, scratch)
    scratch.drop(texts, far, links, roots)
    roots = merged
    scratch.keep(profile, roots)
    return members, roots.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.col("root").alias("root"))


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, th, n_shingles, component_id) of every document; th: xxhash64 of the text."""
    with Scratch(docs.sparkSession) as scratch:
        members, final = _rooted(docs, doc_id, text, words, scratch)
        classes = members.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("low")).join(final, ["a", "b"], "left")
        classes = scratch.saved(classes.select("a", "b", "low", F.coalesce("root", F.struct("b", "a")).alias("root")), "classes")
        scratch.keep(*scratch.paths.values())  # what the result is read from
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("k"))
    many = classes.join(lowest.where("k > 1").select("root", "component_id"), "root").select("a", "b", "component_id")
    named = classes.select("a", "b", "low").join(many, ["a", "b"], "left").select("a", "b", F.coalesce("component_id", "low").alias("component_id"))
    linked = members.where("n > 0").join(named, ["a", "b"]).select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(members.where("n = 0").select("doc_id", "th", "n", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """docs with one document of each component: that with the smallest id, of such texts that with the smallest hash; a null id comes last.

    Components are told apart by their root, as their ids may be null or repeated. Documents without words all stay.
    """
    with Scratch(docs.sparkSession) as scratch:
        members, final = _rooted(docs, doc_id, text, words, scratch)
        scratch.keep(*scratch.paths.values())
    low = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("low")
    classes = members.where("n > 0").groupBy("a", "b").agg(low).join(final, ["a", "b"], "left").select("low", F.coalesce("root", F.struct("b", "a")).alias("root"))
    found = classes.groupBy("root").agg(F.min("low").alias("low")).select("low.doc_id", "low.th").union(members.where("n = 0").select("doc_id", "th"))
    stay_id, stay_th, mark = (free_name(docs, f"_stay_{x}") for x in ("id", "th", "mark"))
    stay = found.select(F.col("doc_id").alias(stay_id), F.col("th").alias(stay_th)).distinct()
    kept = docs.join(stay, docs[doc_id].cast("long").eqNullSafe(F.col(stay_id)) & (F.xxhash64(docs[text].cast("string")) == F.col(stay_th)), "left_semi")
    if members.where("n > 0").groupBy("doc_id", "th").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return kept
    # the same id and text more than once: one row stays
    empty = F.when(F.coalesce(F.btrim(F.col(text).cast("string"), F.lit(SPACES)), F.lit("")) == "", F.monotonically_increasing_id())
    marked = kept.withColumns({stay_th: F.xxhash64(F.col(text).cast("string")), mark: empty})
    return marked.dropDuplicates([doc_id, stay_th, mark]).select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    """The components of all documents."""
    return classify(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive w as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct rid, array_to_string(w[p:p + least(5, len(w)) - 1], ' ') g from (select rid, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) p from w where len(w) > 0)),
n as (select rid, count(*) n from s group by rid),
l as (select x.rid a, y.rid b from s x join s y on x.g = y.g and x.rid <> y.rid group by x.rid, y.rid
      having 100 * count(*) >= 80 * ((select n from n where n.rid = x.rid) + (select n from n where n.rid = y.rid) - count(*))),
r as (select rid a, rid b from n union select r.a, l.b from r join l on r.b = l.a)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, coalesce(c.m, w.doc_id) component_id
from w left join n using (rid) left join (select r.a rid, min(d.doc_id) m from r join w d on d.rid = r.b group by r.a) c using (rid)
"""
