"""Token ids as binary files with Elias-Fano document boundaries.

A file holds the ids of consecutive documents in one array (16 bits an id where the vocabulary allows it), the boundaries
between documents and the documents' own ids, both as Elias-Fano lists with a sampled select structure: about
2 + log2(universe / n) bits a document instead of 64. Documents stand in ascending order of doc_id (null first).

Documents are dealt by ranges of doc_id once; each task encodes, packs and rolls its files. Files are committed through
temporary names and a manifest, on whatever store Spark writes to, one file image a row.

Defined cases: a null or empty text has the end id only; repeated rows and repeated doc_ids each have an entry; empty tables
give no files and no rows; texts of any length are encoded whole (a file ends after the document that fills it). Other
columns of the documents are not stored.
"""

import hashlib
import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .common import commit_files, table

#: Ids after which a file is closed.
FILE_IDS = 4_000_000
END_ID = 2
#: Runs of text that a Python worker remembers at most (about 250 bytes each); then it starts anew.
MAX_REMEMBERED = 800_000
_HEAD = struct.Struct("<4sHHQQQq")
_EF = struct.Struct("<QQB3xII")
_SAMPLE = 64
_MARK = re.compile("[\u0300-\u036f]").search


class EliasFano:
    """A non-decreasing list of integers from 0: low bits in an array, high bits in unary, every 64th one sampled."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(values[-1] // max(1, n)).bit_length() - 1) if n else 0
        low = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        flags[at] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), at[::_SAMPLE].astype("<u4"))

    def get(self, i: int) -> int:
        """The i-th value, by select: from the sample before it over less than 64 ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= rest:
            rest -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(rest):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> (first % 8)
        return ((at - i) << self.low_bits) | (chunk & ((1 << self.low_bits) - 1))

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        low = (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64) if self.low_bits else np.zeros(self.n, np.uint64)
        return ((at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | low

    def pack(self) -> bytes:
        return _EF.pack(self.n, len(self.samples), self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def unpack(cls, data: memoryview) -> tuple["EliasFano", memoryview]:
        n, samples, bits, low, high = _EF.unpack_from(data)
        a = _EF.size
        b, c = a + low, a + low + high
        end = c + 4 * samples
        return cls(n, bits, np.frombuffer(data[a:b], np.uint8), np.frombuffer(data[b:c], np.uint8), np.frombuffer(data[c:end], "<u4")), data[end:]


class TokenFile:
    """One file: doc ids (null ones first, as a count), boundaries, ids."""

    @staticmethod
    def pack(doc_ids: list, counts: list[int], ids: bytes, width: int) -> bytes:
        nulls = sum(d is None for d in doc_ids)
        known = np.array([d for d in doc_ids if d is not None], np.int64)
        first = int(known[0]) if len(known) else 0
        ends = np.cumsum(counts, dtype=np.uint64)
        head = _HEAD.pack(b"QTB1", 1, width, len(doc_ids), len(ids) // width, nulls, first)
        return head + EliasFano.of(known.view(np.uint64) - np.int64(first).view(np.uint64)).pack() + EliasFano.of(ends).pack() + ids

    def __init__(self, data: bytes) -> None:
        magic, version, self.width, self.n, self.n_ids, self.nulls, self.first = _HEAD.unpack_from(data)
        if magic != b"QTB1" or version != 1:
            raise ValueError("not a token file")
        self.docs, rest = EliasFano.unpack(memoryview(data)[_HEAD.size :])
        self.ends, rest = EliasFano.unpack(rest)
        self.ids = np.frombuffer(rest, f"<u{self.width}")
        if len(self.ids) != self.n_ids or self.ends.n != self.n:
            raise ValueError("the file is cut off")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        return self.ids[self.ends.get(k - 1) if k else 0 : self.ends.get(k)]


class _Words:
    """The library's ids of texts; runs between spaces and line ends are encoded once as long as they are remembered.

    The tokenizer drops white space, so nothing that it does reaches over a space or a line end. It folds case, too: A-Z may
    be folded before, unless a mark could combine with the letter or a special token could come about. A full stop or comma
    between a letter and the end of a run is a piece of its own.
    """

    def __init__(self, source: str, width: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_str(source), f"<u{width}"
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        normalizer = json.loads(source).get("normalizer") or {}
        self.folds = any(n.get("type") == "Lowercase" for n in [normalizer, *normalizer.get("normalizers", [])])
        self.reset()

    def reset(self) -> None:
        words = self

        class Index(dict):
            def __missing__(self, word: str) -> int:
                self[word] = n = len(self)
                words.new.append(word)
                return n

        self.index, self.new, self.ids = Index(), [], []
        self.stops = {c: self.encode_all([c])[0] for c in ".,"}

    def encode_all(self, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 20_000):
            out.extend(np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False))
        return out

    def learn(self) -> None:
        """Encodes the runs seen since the last call."""
        cut = [w[:-1] if len(w) > 1 and w[-1] in ".," and w[-2].isascii() and w[-2].isalpha() else w for w in self.new]
        known = self.index
        # a run without its stop that is remembered already, from before
        old = {c: self.ids[known[c]] for w, c in zip(self.new, cut, strict=True) if c is not w and c in known and known[c] < len(self.ids)}
        fresh = list(dict.fromkeys(c for c in cut if c not in old))
        coded = old | dict(zip(fresh, self.encode_all(fresh), strict=True))
        self.ids.extend(coded[c] if c is w else coded[c] + self.stops[w[-1]] for w, c in zip(self.new, cut, strict=True))
        self.new = []

    def runs(self, text: str) -> np.ndarray:
        if self.folds and "<|" not in text:
            if text.isascii():
                text = text.lower()
            elif not _MARK(text):
                text = text.encode("utf-8", "replace").lower().decode()
        return np.fromiter(map(self.index.__getitem__, filter(None, text.replace("\n", " ").split(" "))), np.uint32)

    def encode(self, texts: list) -> list[bytes]:
        numbers = [self.runs(t) if t else None for t in texts]
        self.learn()
        get = self.ids.__getitem__
        out = [b"" if x is None else b"".join(map(get, x.tolist())) for x in numbers]
        if len(self.index) > MAX_REMEMBERED:
            self.reset()
        return out


@lru_cache(maxsize=1)
def _words(source: str, width: int) -> _Words:
    return _Words(source, width)


def write_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> str:
    """Encodes all documents into files under the shared folder; the path of the committed files."""
    import public_tokenizers

    spark = docs.sparkSession
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        source = f.read()
    model = json.loads(source)
    width = 2 if max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]) < 1 << 16 else 4
    shared = spark.sparkContext.broadcast(source)

    def run(batches):
        words, part = _words(shared.value, width), TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{width}").tobytes()
        names, counts, data, size, seq = [], [], [], 0, 0

        def image():
            body = TokenFile.pack(names, counts, b"".join(data), width)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(names)], "n_ids": [size], "sha256": [hashlib.sha256(body).hexdigest()], "image": [body]}, schema=kind)

        for batch in batches:
            for piece in slices(batch, text):
                for name, ids in zip(piece.column(doc_id).to_pylist(), words.encode(piece.column(text).to_pylist()), strict=True):
                    names.append(name)
                    data += [ids, end]
                    counts.append((len(ids) + len(end)) // width)
                    size += counts[-1]
                    if size >= file_ids:
                        yield image()
                        names, counts, data, size, seq = [], [], [], 0, seq + 1
        if names:
            yield image()

    kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("sha256", pa.string()), ("image", pa.binary())])
    dealt = docs.select(F.col(doc_id).cast("long").alias(doc_id), text).repartitionByRange(F.col(doc_id).asc_nulls_first()).sortWithinPartitions(F.col(doc_id).asc_nulls_first())
    return commit_files(dealt.mapInArrow(run, "part int, seq int, n_docs long, n_ids long, sha256 string, image binary"), "tokens", "image")


def _files(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The files that the manifest lists, and the manifest with the ids before each file (one row a file)."""
    files = spark.read.schema("part int, seq int, n_docs long, n_ids long, sha256 string, image binary").parquet(f"{path}/files")
    manifest = spark.read.schema("part int, seq int, n_docs long, n_ids long, sha256 string").parquet(f"{path}/manifest")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files, manifest.select("part", "seq", F.col("sha256").alias("listed"), before.alias("before"))


def read_tokens(spark, path: str, ids: bool = False) -> DataFrame:
    """A row a document, from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids), and with ids=True the ids as an array."""
    files, manifest = _files(spark, path)
    fields = "doc_id long, local long, n_tokens long, ids_crc32 long, part int, seq int, sha256 string" + ", ids array<long>" * ids

    def run(batches):
        for batch in batches:
            for part, seq, digest, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "sha256", "image")), strict=True):
                if hashlib.sha256(image).hexdigest() != digest:
                    raise ValueError(f"file {part}-{seq} does not have the digest that was written")
                f = TokenFile(image)
                ends = f.ends.all().astype(np.int64)
                starts = np.r_[0, ends[:-1]]
                names = [None] * f.nulls + (f.docs.all().view(np.int64) + f.first).tolist()
                wide = memoryview(f.ids.astype("<u4").tobytes())
                rows = {"doc_id": pa.array(names, pa.int64()), "local": starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]}
                rows |= {"part": pa.array([part] * f.n, pa.int32()), "seq": pa.array([seq] * f.n, pa.int32()), "sha256": [digest] * f.n}
                if ids:
                    rows["ids"] = [f.ids[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(rows)

    rows = files.mapInArrow(run, fields)
    joined = rows.join(manifest, ["part", "seq"])
    checked = F.when(F.col("sha256") == F.col("listed"), F.col("local") + F.col("before")).otherwise(F.raise_error(F.lit("a file is not the one that the manifest lists")).cast("long"))
    return joined.select("doc_id", checked.alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def op8(spark, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents")))
