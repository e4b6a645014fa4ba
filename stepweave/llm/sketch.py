"""A count-min sketch of 64-bit fingerprints that answers one question: seen once, or perhaps more often.

Each task turns its fingerprints into cell numbers, and those into rows of a
shard of the sketch, sorted and written as gaps of about a byte.  Shards are
summed in parallel with counts that stop at two, and only the final bits travel:
``depth * 2**bits / 8`` bytes, whatever the input.  A small sketch overestimates
more often and never underestimates.  ``levelled`` also gives how common the
cells of the first line are, in classes of a count's logarithm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .rolling import U

SHARDS = 16
DEPTH = 2
_ODD = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F], U)
ROWS = "line int, shard int, once binary, more binary, counts binary"
_ARROW = pa.schema([("line", pa.int32()), ("shard", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])
_BITS = pa.schema([("line", pa.int32()), ("shard", pa.int32()), ("bits", pa.binary()), ("levels", pa.binary()), ("weight", pa.list_(pa.float64()))])
#: Cells of the first line that share a level, as a power of two, and the number of levels.
LEVEL_CELLS, LEVELS = 4, 64


def bits_for(df: DataFrame, least: int = 20, most: int = 28) -> int:
    """Cells per line as a power of two: a quarter of the bytes of the tables that ``df`` reads, within fixed bounds (32 MB a line at most)."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(least, min(most, (max(size, 8) // 4 - 1).bit_length()))


def _cells(fp: np.ndarray, line: int, bits: int) -> np.ndarray:
    return ((fp * _ODD[line]) >> U(64 - bits)).astype(np.uint32)


def _gaps(cells: np.ndarray) -> bytes:
    """Ascending cells as bytes: each gap, with a 255 for every 255 that it holds."""
    gap = np.diff(cells.astype(np.int64), prepend=0)
    over = gap // 255
    out = np.full(int(over.sum()) + len(gap), 255, np.uint8)
    out[np.cumsum(over + 1) - 1] = gap % 255
    return out.tobytes()


def _ungapped(data: bytes) -> np.ndarray:
    v = np.frombuffer(data, np.uint8)
    return np.cumsum(v, dtype=np.int64)[v != 255]


def partial_rows(batches: Iterator[np.ndarray], bits: int, flush: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Sketch rows of one task's fingerprints, of bounded size each."""

    def rows(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = []
        for line in range(DEPTH):
            cell, count = np.unique(_cells(fp, line, bits), return_counts=True)
            shard = cell >> np.uint32(bits - 4)
            for s in np.unique(shard):
                a, b = np.searchsorted(shard, [s, s + 1])
                local, n = cell[a:b] & np.uint32((1 << (bits - 4)) - 1), count[a:b]
                some = np.minimum(n[n > 1], 65535).astype(np.uint16) if line == 0 else np.zeros(0, np.uint16)
                out.append((line, int(s), _gaps(local[n == 1]), _gaps(local[n > 1]), some.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    held, size = [], 0
    for fp in batches:
        held.append(fp)
        size += len(fp)
        if size >= flush:
            yield from rows(np.concatenate(held))
            held, size = [], 0
    if size:
        yield from rows(np.concatenate(held))


def _sums(rows: DataFrame, bits: int, levels: bool) -> list:
    """A row for each line and shard: which cells hold two or more, and with ``levels`` how common they are."""
    cells = 1 << (bits - 4)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for line, shard, once, more, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                full = levels and line == 0
                at = state.setdefault((line, shard), np.zeros(cells, np.uint16 if full else np.uint8))
                one, several = _ungapped(once), _ungapped(more)
                most = 65535 if full else 2
                at[one] = np.minimum(at[one].astype(np.uint32) + 1, most)
                at[several] = np.minimum(at[several].astype(np.uint32) + np.frombuffer(counts, np.uint16), most) if full else 2
        for (line, shard), at in state.items():
            packed = np.packbits(at >= 2, bitorder="little").tobytes()
            level, weight = b"", []
            if at.dtype == np.uint16:
                often = at.astype(np.uint32).reshape(-1, min(cells, 1 << LEVEL_CELLS)).max(axis=1)
                of = np.minimum(LEVELS - 1, np.floor(4 * np.log2(np.maximum(often, 1)))).astype(np.uint8)
                many = np.where(at >= 2, at, 0).reshape(len(of), -1).sum(axis=1)
                level, weight = of.tobytes(), np.bincount(of, weights=many, minlength=LEVELS).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((line, shard, packed, level, weight), _BITS.types, strict=True)], schema=_BITS)

    return rows.repartition(DEPTH * SHARDS, "line", "shard").mapInArrow(add, "line int, shard int, bits binary, levels binary, weight array<double>").collect()


def merged(spark: SparkSession, rows: DataFrame, bits: int) -> Broadcast:
    """The cells counted twice or more, one packed array for each line."""
    lines = np.zeros((DEPTH, SHARDS, (1 << (bits - 4)) // 8), np.uint8)
    found = _sums(rows, bits, False)
    while found:  # each is let go once it is copied
        r = found.pop()
        lines[r.line, r.shard] = np.frombuffer(bytes(r.bits), np.uint8)
    return spark.sparkContext.broadcast(lines.reshape(DEPTH, -1))


def levelled(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells counted twice or more; the level of every 2**LEVEL_CELLS cells of the first line; and how many repeated fingerprints each level holds."""
    lines = np.zeros((DEPTH, SHARDS, (1 << (bits - 4)) // 8), np.uint8)
    levels, weight = np.zeros((SHARDS, (1 << (bits - 4)) >> LEVEL_CELLS), np.uint8), np.zeros(LEVELS)
    found = _sums(rows, bits, True)
    while found:
        r = found.pop()
        lines[r.line, r.shard] = np.frombuffer(bytes(r.bits), np.uint8)
        if r.line == 0:
            levels[r.shard] = np.frombuffer(bytes(r.levels), np.uint8)
            weight += r.weight
    return lines.reshape(DEPTH, -1), levels.reshape(-1), weight


def level_of(levels: np.ndarray, fp: np.ndarray, bits: int) -> np.ndarray:
    return levels[_cells(fp, 0, bits) >> np.uint32(LEVEL_CELLS)]


def repeated(lines: np.ndarray, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """True where a fingerprint's count, as the sketch has it, is two or more."""
    def ask(fp: np.ndarray) -> np.ndarray:
        out = np.ones(len(fp), bool)
        for line, table in enumerate(lines):
            cell = _cells(fp, line, bits)
            out &= (table[cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8)) & 1 == 1
        return out

    return ask
