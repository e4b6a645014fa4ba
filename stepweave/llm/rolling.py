"""Rolling hashes over whole Arrow batches of text, in numpy.

Units are words or bytes.  All documents of a chunk lie one after another in
one array, and windows that cross a document are masked out, so there is no
Python loop over units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_draw = np.random.default_rng(88172645463325252)
BYTE_HASH = _draw.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
STEP = _draw.integers(1, 2**63, 64, dtype=U) * U(2) + U(1)
#: A-Z to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets in them) of consecutive rows of about ``limit`` bytes; a longer text is a chunk of its own. Null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


_power = {"up": np.ones(1, U), "down": np.ones(1, U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _power[name] = np.multiply.accumulate(x)
    up, down = _power["up"][:n], _power["down"][:n]
    if len(_power["up"]) > 8 * CHUNK:  # after a very long text
        _power["up"], _power["down"] = _power["up"][:CHUNK].copy(), _power["down"][:CHUNK].copy()
    return up, down


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each white-space word, and for each row the number of words before it (one more entry than rows)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(BYTE_HASH[LOWER[data] if lower else data] * up[:n], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * BASE)
    return h, start, end, np.searchsorted(start, offsets, "left")


def fold(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of ``m`` consecutive units at each place where they fit."""
    n = len(h) - m + 1
    if n <= 0:
        return np.zeros(0, U)
    block, size, out, done = h, 1, None, 0
    while True:
        if m & size:
            if out is None:
                out, done = block, size
            else:
                keep = min(len(out), len(block) - done)
                out = out[:keep] * STEP[size.bit_length() + 31] + block[done : done + keep]
                out ^= out >> U(31)
                done += size
        if size * 2 > m:
            break
        block = block[:-size] * STEP[size.bit_length()] + block[size:]
        block ^= block >> U(31)
        size *= 2
    return mix(out[:n])


def stretches(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hash of each stretch h[starts[i]:starts[i]+counts[i]], by all its units and their order."""
    up, down = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h) * up[: len(h)], out=total[1:])
    return mix((total[starts + counts] - total[starts]) * down[starts])


def sliding(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over each ``width`` consecutive entries."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def valid_windows(bounds: np.ndarray, length: int, n: int) -> np.ndarray:
    """Starts of windows of ``length`` units that lie in one row; ``bounds``: first unit of each row, then the end."""
    if n < length:
        return np.zeros(0, bool)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    return row[: n - length + 1] == row[length - 1 :]


def runs(h: np.ndarray, bounds: np.ndarray, length: int, gram: int, anchors: bool = False) -> dict[str, np.ndarray]:
    """Windows of ``length`` units, as runs of consecutive windows with the same fingerprint.

    A window's fingerprint is the least hash of its grams, so equal windows have
    equal fingerprints.  Gives row, start (in units of the row), n (windows),
    fp, at (start in the chunk); with ``anchors`` also the hash of each place
    that is the least gram of some window, once per place.
    """
    n = len(h)
    ok = valid_windows(bounds, length, n)
    index = np.flatnonzero(ok)
    if not len(index):
        none = np.zeros(0, np.int64)
        return {"row": none, "start": none, "n": none, "fp": np.zeros(0, U), "at": none, "anchors": np.zeros(0, U)}
    grams = fold(h, gram)
    least = sliding(grams, length - gram + 1)
    kept = least[index]
    new = np.ones(len(index), bool)
    new[1:] = (kept[1:] != kept[:-1]) | (index[1:] != index[:-1] + 1)
    cut = np.flatnonzero(new)
    at = index[cut]
    row = np.searchsorted(bounds, at, "right") - 1
    out = {"row": row, "start": at - bounds[row], "n": np.diff(np.append(cut, len(index))), "fp": kept[cut], "at": at}
    if anchors:
        width = length - gram + 1
        most = np.zeros(len(least) + 2 * (width - 1), U)
        most[width - 1 : width - 1 + len(least)] = np.where(ok, least, U(0))
        out["anchors"] = grams[grams == sliding(most, width, np.maximum)]
    return out


def joined(counts: np.ndarray, starts: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices source[starts[i]:starts[i]+counts[i]] one after another, and their offsets."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, counts)
    return source[place], offsets


def slices(source: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The slices of ``source`` as binary values."""
    size = source.itemsize
    flat, offsets = joined(counts, starts, source)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets * size), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(U)
