"""Byte-level BPE encoding and decoding with a pair occurrence index.

Every task keeps the distinct pre-tokens of its rows. New ones are laid out as one array of symbols with links to the
neighbours inside a pre-token; an index maps each pair (by its merge rank) to all its positions. Active ranks are applied in
ascending order, each to all its positions at once, and the lists of the pairs around the merged places are updated.

Defined cases: a null or empty text has no ids; special tokens of the file that occur in a text become their ids; texts of any
length are encoded whole; repeated rows are encoded alike; empty tables have no rows. Extra columns pass through; one named like the result is replaced.
Ids are kept as little-endian unsigned 32-bit integers in a binary column (ids_array() gives an array).
"""

import heapq
import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, trimmed

#: Pre-tokens that a task remembers at most; then it starts anew.
MAX_CACHED = 200_000
#: Characters of text that are encoded (and sent on) at a time; a longer text is a slice of its own.
SLICE_CHARS = 2_000_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Merges:
    """The merges of a BPE file: ids of bytes, and for each pair its rank and what it becomes."""

    def __init__(self, source: str) -> None:
        model = json.loads(source)
        vocabulary = model["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.byte_ids = np.array([vocabulary[c] for c in byte_chars()], np.int64)
        self.left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        born = np.full(self.size, -1, np.int64)
        born[self.made] = np.arange(len(pairs))
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before its parts are made: ranks can't be applied in ascending order")
        of = {c: b for b, c in enumerate(byte_chars())}
        texts = [b""] * self.size
        for token, i in vocabulary.items():
            texts[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.token_len = np.array([len(t) for t in texts], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        ends = np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            """Enters the pairs that start at these positions into the index."""
            at = at[after[at] >= 0]
            rank = self.ranks(symbols[at], symbols[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.r_[0, cuts]].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        note(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (symbols[at] == a)]
            at = at[after[at] >= 0]
            at = at[symbols[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping places the first wins
                at = np.sort(at)
                taken, free = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != free:
                        taken.append(p)
                        free = q
                at = np.array(taken, np.int64)
            if not len(at):
                continue
            gone = after[at]
            symbols[at] = self.made[r]
            alive[gone] = False
            after[at] = after[gone]
            follows = after[at] >= 0
            before[after[at][follows]] = at[follows]
            left = before[at]
            note(np.unique(np.concatenate([left[left >= 0], at])))
        kept = np.concatenate([[0], np.cumsum(alive)])
        bounds = (kept[ends] * 4).tolist()
        data = symbols[alive].astype("<u4").tobytes()
        return [data[i:j] for i, j in zip([0, *bounds[:-1]], bounds, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens; ids outside the vocabulary have none."""
        ids = ids[ids < self.size].astype(np.int64)
        lengths = self.token_len[ids]
        ends = np.cumsum(lengths)
        return self.token_bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.token_at[ids] - (ends - lengths), lengths)].tobytes()


class Encoder:
    """Texts to ids; remembers at most MAX_CACHED pre-tokens."""

    def __init__(self, merges: Merges, pattern: str) -> None:
        compiled = regex.compile(pattern)
        self.merges, self.find, self.finder = merges, compiled.findall, compiled.finditer
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")").split if merges.special else None
        self.reset()

    def reset(self) -> None:
        encoder = self

        class Index(dict):
            def __missing__(self, word: str) -> int:
                self[word] = n = len(self)
                encoder.new.append(word)
                return n

        self.index, self.new, self.ids = Index(), [], []

    def words(self, text: str) -> array:
        """Numbers of the text's pre-tokens; a special token counts as one."""
        found = array("I")
        if self.parts and any(s in text for s in self.merges.special):
            for k, part in enumerate(self.parts(text)):
                found.extend([self.index["\0special" + part]] if k % 2 else map(self.index.__getitem__, self.find(part)))
            return found
        found.extend(map(self.index.__getitem__, self.find(text)))
        return found

    def learn(self) -> None:
        """Encodes the pre-tokens seen since the last call."""
        plain = [w for w in self.new if not w.startswith("\0special") or w[8:] not in self.merges.special]
        coded = dict(zip(plain, self.merges.encode([w.encode("utf-8", "replace") for w in plain]), strict=True))
        for w in self.new:
            self.ids.append(coded[w] if w in coded else np.array([self.merges.special[w[8:]]], "<u4").tobytes())
        self.new = []

    def encode(self, texts: list) -> list[bytes]:
        numbers = [self.words(t) if t else None for t in texts]
        self.learn()
        get = self.ids.__getitem__
        out = [b"" if x is None else b"".join(map(get, x)) for x in numbers]
        self.forget()
        return out

    def forget(self) -> None:
        """Keeps the memory bounded; numbers of pre-tokens are void after it."""
        if len(self.index) > MAX_CACHED:
            self.reset()


@lru_cache(maxsize=2)
def _merges(source: str) -> Merges:
    return Merges(source)


@lru_cache(maxsize=2)
def encoder(source: str, pattern: str) -> Encoder:
    return Encoder(_merges(source), pattern)


def tokenizer_file(spark, path: str | None):
    """The tokenizer file, read on the driver and broadcast (a vocabulary: its size does not depend on the data)."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read()), public_tokenizers.PATTERN


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_CHARS):
    """Parts of a batch with about so many bytes of the column each."""
    column = batch.column(text)
    width = np.cumsum([0, *(len(v.as_buffer()) if v.is_valid else 0 for v in column)])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(width, width[at] + most)))
        yield batch.slice(at, end - at)
        at = end


def bpe_encode(df: DataFrame, text: str = "text", into: str = "ids", path: str | None = None, keep: bool = True) -> DataFrame:
    """df with the ids of every whole text; keep=False leaves the text out of the result."""
    source, pattern = tokenizer_file(df.sparkSession, path)
    df = df.drop(*[c for c in df.columns if c.lower() == into.lower()])
    fields = [f for f in df.schema.fields if keep or f.name != text]

    def run(batches):
        enc = encoder(source.value, pattern)
        for batch in batches:
            for part in slices(batch, text):
                ids = enc.encode(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(ids, pa.binary())], names=[*(f.name for f in fields), into])
        enc.reset()

    return df.mapInArrow(trimmed(run), T.StructType([*fields, T.StructField(into, T.BinaryType())]))


def bpe_decode(df: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None, keep: bool = True) -> DataFrame:
    """df with the text that the ids stand for (null ids: empty; bytes that are no UTF-8 become U+FFFD)."""
    source, _ = tokenizer_file(df.sparkSession, path)
    df = df.drop(*[c for c in df.columns if c.lower() == into.lower()])
    fields = [f for f in df.schema.fields if keep or f.name != ids]

    def run(batches):
        merges = _merges(source.value)
        for batch in batches:
            for part in slices(batch, ids):
                texts = [merges.decode(np.frombuffer(v, "<u4")).decode("utf-8", "replace") if v else "" for v in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(texts, pa.string())], names=[*(f.name for f in fields), into])

    return df.mapInArrow(trimmed(run), T.StructType([*fields, T.StructField(into, T.StringType())]))


def bpe_code(df: DataFrame, text: str = "text", ids: str = "ids", into: str = "decoded", path: str | None = None, keep: bool = True) -> DataFrame:
    """df with the ids of every whole text and the text decoded from these, in one pass: bpe_decode(bpe_encode()), with one worker a task.

    into may name the text itself, which is then replaced; keep=False leaves the text out otherwise.
    """
    source, pattern = tokenizer_file(df.sparkSession, path)
    gone = {ids.lower(), into.lower()} - {text.lower()}
    fields = [f for f in df.schema.fields if f.name.lower() not in gone and (keep or f.name != text or into == text)]
    schema = T.StructType([*fields, T.StructField(ids, T.BinaryType()), *([] if into == text else [T.StructField(into, T.StringType())])])

    def run(batches):
        enc, merges = encoder(source.value, pattern), _merges(source.value)
        for batch in batches:
            for part in slices(batch, text):
                coded = enc.encode(part.column(text).to_pylist())
                decoded = pa.array([merges.decode(np.frombuffer(v, "<u4")).decode("utf-8", "replace") if v else "" for v in coded], pa.string())
                columns = [decoded if f.name == text and into == text else part.column(f.name) for f in fields]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(coded, pa.binary()), *([] if into == text else [decoded])], names=schema.names)
        enc.reset()

    return df.mapInArrow(trimmed(run), schema)


def ids_array(ids: Column) -> Column:
    """A binary column of ids as array<bigint>."""
    number = lambda k: F.conv(F.concat(*[F.substring(F.hex(F.substring(ids, k * 4 + 4 - j, 1)), 1, 2) for j in range(4)]), 16, 10).cast("long")
    return F.when(F.length(ids) >= 4, F.transform(F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1), number)).otherwise(F.array().cast("array<bigint>"))


def op2(spark, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_code(docs, keep=False)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
