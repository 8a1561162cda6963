"""Sharding by histogram sort: rows are dealt into shards of near equal bytes by ranges of a sort key.

Rows are ordered by (hash of the text, hash of the id, number of the row in the written key table). So equal texts stand
together, and a group of copies larger than a shard is split where it has to be. The keys are read as digits of 12 bits. A
round counts, across all partitions, the exact bytes in every cell between the candidate boundaries that are still open;
a boundary that is within tolerance is settled, the others are refined inside the one cell that holds their target. A round
sends at most 4096 counts for each open boundary, whatever the number of rows. Then the rows are exchanged once, by shard and
cell: a large shard is dealt into cells of bounded size, whose rows are numbered from the counts of the cells before them.

Law: ``bytes``. Every boundary is within ``tolerance`` of a shard's bytes from its target, or as near as whole rows allow.

Defined cases: a null text has 16 bytes and the crc of nothing; a null id has a place of its own; repeated rows are told apart
by their number; very long texts count whole; an empty table has no rows. Extra columns pass through shard() and columns named like a result are replaced.
"""

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

SHARDS = 40
#: Bytes that each row counts beside its text.
ROW_BYTES = 16
#: Share of a shard's bytes by which a boundary may miss its target.
TOLERANCE = 0.002
#: Rows of a shard that one task numbers, about; a shard with more is dealt into cells by a hash.
CELL_ROWS = 1 << 20
_BITS = 12
_KEYS = ("k1", "k2", "k3")


def _digits() -> list:
    """The key columns as digits, the first counting most: (key, shift, bits)."""
    return [(k, max(0, 64 - _BITS * (i + 1)), min(_BITS, 64 - _BITS * i)) for k in _KEYS for i in range(-(-64 // _BITS))]


def _digit(key: str, shift: int, bits: int):
    """A digit of a key that orders as an unsigned number."""
    return F.shiftrightunsigned(F.col(key), shift).bitwiseAND(F.lit((1 << bits) - 1))


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple]:
    """Boundaries: for each one the digits of the first cell that belongs to the shard above it (fewer digits where that is enough).

    keys: k1, k2, k3, size. Returned in ascending order, one for each of shards - 1; rows whose digits are not below it lie above.
    """
    digits = _digits()
    open_, settled, total, slack = None, {}, None, 0.0
    for level, (key, shift, bits) in enumerate(digits):
        cell = _digit(key, shift, bits).alias("cell")
        if open_ is None:
            counts = {(): keys.groupBy(cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
            total = sum(r["bytes"] for r in counts[()])
            slack = tolerance * total / shards
            open_ = {b: ((), 0) for b in range(1, shards)}
        else:
            prefixes = sorted({p for p, _ in open_.values()})
            depth = len(prefixes[0])
            inside = lambda p: reduce(and_, [_leading(k, depth, digits) == F.lit(v) for k, v in zip(_KEYS, _shifted(p, digits), strict=True)])
            group = F.coalesce(*[F.when(inside(p), F.lit(i)) for i, p in enumerate(prefixes)])  # fewer than there are shards
            rows = keys.select(cell, "size", group.alias("group")).where("group is not null").groupBy("group", "cell").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
            counts = {p: [] for p in prefixes}
            for r in rows:
                counts[prefixes[r["group"]]].append(r)
        still = {}
        for b, (prefix, below) in open_.items():
            target, at = b * total / shards, below
            for r in sorted(counts[prefix], key=lambda r: r["cell"]):
                if at + r["bytes"] < target:
                    at += r["bytes"]
                    continue
                here = (*prefix, r["cell"])
                if target - at <= slack:
                    settled[b] = here
                elif at + r["bytes"] - target <= slack:
                    settled[b] = _after(here, digits)
                elif level + 1 < len(digits) and r["rows"] > 1:
                    still[b] = (here, at)
                else:
                    settled[b] = here if target - at <= at + r["bytes"] - target else _after(here, digits)
                break
            else:
                settled[b] = None  # no row lies above
        open_ = still
        if not open_:
            break
    return [settled[b] for b in range(1, shards)]


def _after(cell: tuple, digits: list) -> tuple | None:
    """The cell that follows; None after the last one."""
    for i in range(len(cell) - 1, -1, -1):
        if cell[i] + 1 < 1 << digits[i][2]:
            return (*cell[:i], cell[i] + 1)
    return None


def _leading(key: str, depth: int, digits: list):
    """The part of a key that the first digits hold."""
    shifts = [shift for k, shift, _ in digits[:depth] if k == key]
    return F.shiftrightunsigned(F.col(key), shifts[-1]) if shifts else F.lit(0).cast("long")


def _shifted(cell: tuple, digits: list) -> list[int]:
    """A cell's digits as the values that _leading() has in its rows."""
    out = []
    for k in _KEYS:
        mine = [(v, shift) for v, (key, shift, _) in zip(cell, digits, strict=False) if key == k]
        value = sum(v << shift for v, shift in mine) >> mine[-1][1] if mine else 0
        out.append(value - (1 << 64) if value >= 1 << 63 else value)
    return out


def _padded(cell: tuple, digits: list) -> list[int]:
    """A cell's first key, as signed longs that order like the keys with their top bit turned."""
    out = []
    for k in _KEYS:
        value = 0
        for i, (key, shift, _) in enumerate(digits):
            if key == k and i < len(cell):
                value |= cell[i] << shift
        out.append(value - (1 << 63))
    return out


def shard(df: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, keep: bool = True, cell_rows: int = CELL_ROWS) -> DataFrame:
    """df with size, text_crc32, law, shard, slot and grown_shard; keep=False returns only the id with them."""
    results = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    df = df.drop(*[c for c in df.columns if c.lower() in results])
    whole = F.coalesce(F.col(text), F.lit("")).cast("string")
    kept = df.columns if keep else [doc_id]
    keys = df.select(
        *[F.col(c).alias(f"c_{i}") for i, c in enumerate(kept)],
        F.xxhash64(F.lit(0), whole).alias("k1"),
        F.xxhash64(F.lit(1), F.col(doc_id)).alias("k2"),
        F.monotonically_increasing_id().alias("k3"),
        (F.octet_length(whole) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
    )
    keys = saved(keys, "shard-keys")  # the number of a row is fixed from here on
    digits = _digits()
    bounds = splitters(keys.select(*_KEYS, "size"), shards, tolerance) if shards > 1 else []
    top = F.lit(-(1 << 63))
    mine = F.struct(*[F.col(k).bitwiseXOR(top) for k in _KEYS])
    above = [F.struct(*[F.lit(v) for v in _padded(b, digits)]) for b in bounds if b is not None]
    placed = keys.withColumn("shard", F.size(F.filter(F.array(*above), lambda b: mine >= b)).cast("int") if above else F.lit(0))
    per_cell = max(1, cell_rows)
    cells = max(1, -(-keys.count() // (shards * per_cell)))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("k1", "k3"), F.lit(cells)) if cells > 1 else F.lit(0).cast("long"))
    window = Window.partitionBy("shard", "cell").orderBy(*[F.col(k).bitwiseXOR(top) for k in _KEYS])
    slot = F.row_number().over(window).cast("long") - 1
    if cells > 1:  # rows before each cell of a shard, from counts
        counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
        before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.join(counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), ["shard", "cell"])
        slot = slot + F.col("before")
    return placed.select(
        *[F.col(f"c_{i}").alias(c) for i, c in enumerate(kept)],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 of near equal bytes."""
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
