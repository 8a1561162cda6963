"""WARC archives: a deterministic sharded writer and a verifying reader.

Records are dealt into ranges of their order (id, hash of the digest) that begin at multiples of a number of payload bytes, counted
exactly over all pages. A task regenerates the headers and digests of whole ranges, compresses every record as a gzip member and
closes a file at the end of a range or once it has enough compressed bytes. So the files depend on the pages and the parameters
alone, whatever the number of partitions. Of records with equal payloads of at least 100 bytes that with the
smallest id is a response and the others are revisits that refer to it; smaller payloads are always responses. File images
are committed through temporary names and a manifest, on whatever store Spark writes to.

Defined cases: a null payload is empty; a null url gives a placeholder URI and reads back as null; a null id is kept as null,
and its record is a response unless an equal payload has an id; rows that repeat the smallest id are all responses; an empty
table gives no files and no rows; very long payloads are records of their own size; equal rows stay in one range. Columns other
than id, url and payload are not stored.
"""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import commit_files, saved, table

#: Compressed bytes after which a file is closed, and zlib's level.
FILE_BYTES = 8 << 20
LEVEL = 4
#: Payload bytes of a range, and the most ranges there are: beyond, ranges grow, so that their starts (16 bytes each) can be broadcast.
RANGE_BYTES = 4 * FILE_BYTES
MOST_RANGES = 1 << 20
#: Tasks that write files, at most: each takes one range, or every MOST_TASKS-th.
MOST_TASKS = 1 << 15
#: What a record without payload counts in its range, about its headers.
_HEAD_BYTES = 512
#: Payloads below this size are never revisits.
LEAST_BYTES = 100
_URN = "urn:x-quillspark:page:"
_NO_URI = "urn:x-quillspark:no-uri"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILE = "part int, seq int, n_records long, n_bytes long, sha256 string, image binary"
#: Parts that the rows of one digest are dealt into when they look for the first of them.
SALT = 16


def _uri(url: str | None) -> str:
    return _NO_URI if url is None else "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(page_id, url, payload: bytes, digest: str, first, date: str) -> bytes:
    """A record; first: the id of the response that it revisits, or None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{first}>"] if first is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    gz = zlib.compressobj(level, wbits=31)
    return gz.compress(data) + gz.flush()


def info(name: str, date: str) -> bytes:
    """The record that a file begins with."""
    block = b"software: quillspark\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:x-quillspark:file:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


_INFO = b"WARC/1.1\r\nWARC-Type: warcinfo\r\n"


def file_name(part: int, seq: int) -> str:
    return f"{part:07d}-{seq:05d}.warc.gz"


def members(image: bytes, step: int = 1 << 16):
    """The gzip members of a file, each decompressed."""
    view, at = memoryview(image), 0
    while at < len(view):
        d, parts = zlib.decompressobj(wbits=31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("the last record is cut off")
            piece = view[at : at + step]
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """A record's fields; digests and lengths are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError("a block does not have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not have its digest")
    number = lambda urn: None if urn.endswith(":None") else int(urn.removeprefix(f"<{_URN}").removesuffix(">"))
    url, refers = fields["WARC-Target-URI"], fields.get("WARC-Refers-To")
    page = fields["WARC-Record-ID"].replace(">", "")
    return {
        "page_id": number(page),
        "url": None if url == _NO_URI else url,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number(refers) if refers else None,
        "payload": payload.decode() if fields["WARC-Type"] == "response" else None,
    }


def _revisits(pages: DataFrame) -> DataFrame:
    """(id, first) of the rows that revisit an earlier one; only ids and digests are shuffled, a frequent digest in SALT parts."""
    narrow = pages.where(F.octet_length("payload") >= LEAST_BYTES).select("id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where(F.col("last") > F.col("first"))
    firsts = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    return salted.join(firsts, ["digest", "salt"]).where(F.col("id") > F.col("first")).select("id", "digest", "first").distinct()


def _starts(rows: DataFrame, range_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The (key, hash) at which each range begins, ascending: at most MOST_RANGES, found by exact sums of bytes over (key, hash, bytes)."""
    sized = rows.groupBy("key", "hash").agg(F.sum("bytes").alias("bytes")).repartitionByRange("key", "hash")
    sized = saved(sized.withColumn("at", F.spark_partition_id()), "warc-sizes")
    totals = sized.groupBy("at").agg(F.sum("bytes").alias("bytes"))
    whole = totals.agg(F.sum("bytes")).first()[0] or 0
    step = max(range_bytes, -(-whole // MOST_RANGES))
    # One row a partition: the bytes before it.
    before = totals.select("at", (F.sum("bytes").over(Window.orderBy("at")) - F.col("bytes")).alias("before"))
    running = F.sum("bytes").over(Window.partitionBy("at").orderBy("key", "hash")) - F.col("bytes")
    placed = sized.withColumn("running", running).join(before, "at").withColumn("range", F.floor((F.col("before") + F.col("running")) / F.lit(step)))
    found = placed.groupBy("range").agg(F.min(F.struct("key", "hash")).alias("start")).select("range", "start.key", "start.hash").toArrow().sort_by("range")
    return found["key"].to_numpy(), found["hash"].to_numpy()


def _range_of(spark, starts: tuple[np.ndarray, np.ndarray]):
    """A function of the columns (key, hash): the number of the range."""
    shared = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("int")
    def place(key: pd.Series, hashed: pd.Series) -> pd.Series:
        keys, hashes = shared.value
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        for i in np.flatnonzero(low < high):
            low[i] += np.searchsorted(hashes[low[i] : high[i]], hashed[i], "right")
        return pd.Series(low - 1)

    return place


def write_warc(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, level: int = LEVEL, range_bytes: int = RANGE_BYTES
) -> str:
    """Writes all pages; the path of the committed archive."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("string")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # What revisits what travels as rows of its own through the one exchange of the payloads, just before the page it belongs to.
    notes = saved(_revisits(rows), "warc-revisits").select("id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "digest", "first")
    both = rows.withColumn("first", F.lit(None).cast("long")).unionByName(notes)
    # Null ids sort first; where the least long is an id too, it only shares their ranges.
    key, hashed = F.coalesce("id", F.lit(-(1 << 63))), F.xxhash64("digest")
    starts = _starts(rows.select(key.alias("key"), hashed.alias("hash"), (F.octet_length("payload") + _HEAD_BYTES).cast("long").alias("bytes")), range_bytes)
    place = _range_of(pages.sparkSession, starts)
    order = ["range", F.col("id").asc_nulls_first(), F.col("first").isNull(), hashed, "digest", "url"]
    dealt = both.withColumn("range", place(key, hashed)).repartitionById(max(1, min(len(starts[0]), MOST_TASKS)), F.col("range")).sortWithinPartitions(*order)

    def run(batches):
        part, seq, members_, size = None, 0, [], 0
        of, firsts = None, {}

        def image():
            body = _member(info(file_name(part, seq), date), level) + b"".join(members_)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_records": [len(members_)], "n_bytes": [len(body)], "sha256": [hashlib.sha256(body).hexdigest()], "image": [body]}, schema=kind)

        for batch in batches:
            for k in range(batch.num_rows):
                i, u, text, digest, first, at = (c[k].as_py() for c in batch.columns)
                if at != part:
                    if members_:
                        yield image()
                    part, seq, members_, size, of, firsts = at, 0, [], 0, None, {}
                if first is not None:
                    of, firsts = i, {digest: first} | (firsts if of == i else {})
                    continue
                first = firsts.get(digest) if of == i and i is not None else None
                members_.append(_member(record(i, u, text.encode(), digest, first, date), level))
                size += len(members_[-1])
                if size >= file_bytes:
                    yield image()
                    seq, members_, size = seq + 1, [], 0
        if members_:
            yield image()

    kind = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("image", pa.binary())])
    return commit_files(dealt.mapInArrow(run, _FILE), "warc", "image")


def read_warc(spark, path: str, payloads: bool = False) -> DataFrame:
    """A row a record of the files that the manifest lists, verified."""
    files = spark.read.schema(_FILE).parquet(f"{path}/files")
    listed = spark.read.schema("part int, seq int, n_records long, n_bytes long, sha256 string").parquet(f"{path}/manifest").select("part", "seq", F.col("sha256").alias("listed"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    kind = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes", "refers_to") else pa.string()) for n in names] + [("part", pa.int32()), ("seq", pa.int32()), ("sha256", pa.string())])
    fields = ", ".join(f"{n} {'long' if n in ('page_id', 'payload_bytes', 'refers_to') else 'string'}" for n in names) + ", part int, seq int, sha256 string"

    def run(batches):
        for batch in batches:
            for part, seq, digest, image in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "sha256", "image")), strict=True):
                if hashlib.sha256(image).hexdigest() != digest:
                    raise ValueError(f"file {part}-{seq} does not have the digest that was written")
                at = {"part": part, "seq": seq, "sha256": digest}
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} | at for r in (parse(x) for x in members(image) if not x.startswith(_INFO))], schema=kind)

    return files.mapInArrow(run, fields).join(listed, ["part", "seq"]).where(F.col("sha256") == F.col("listed")).select(*names)


def op9(spark, sf_dir: str) -> DataFrame:
    """All pages written and read back."""
    found = read_warc(spark, write_warc(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') h, sha256(coalesce(html, '')) d from pages),
f as (select d, min(page_id) first from p group by d)
select page_id, cast(strlen(h) as bigint) payload_bytes, d payload_digest,
  case when strlen(h) >= 100 and page_id > first then 'revisit' else 'response' end record_type,
  case when strlen(h) >= 100 and page_id > first then first end refers_to
from p join f using (d)
"""
