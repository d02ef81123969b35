"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of bytes other than space and \\x09-\\x0D, with A-Z
lower-cased. Nulls count as empty texts. Work goes in slices of a few hundred
kilobytes, so memory doesn't follow the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a fresh array."""
    x = x ^ (x >> np.uint64(32))
    x *= _M
    x ^= x >> np.uint64(29)
    x *= _P
    x ^= x >> np.uint64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _P, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _tables or len(_tables[0]) < n:
        _tables[:] = _powers(max(n, 2 * SLICE_BYTES))
    return _tables[0][:n], _tables[1][:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, lower-cased unless asked not to, offsets of rows) of runs of rows of about ``limit`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type != pa.large_string():
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        part = raw[at[first] : at[last]]
        yield first, _LOWER[part] if lower else part, at[first : last + 1] - at[first]
        first = last


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word's index of every row (with the total at the end)."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(at), np.int64)
    word = ~_SPACE[data]
    head = word.copy()
    head[1:] &= ~word[:-1]
    begins = at[:-1][at[:-1] < at[1:]]
    head[begins] |= word[begins]
    tail = word.copy()
    tail[:-1] &= ~word[1:]
    ends = begins[1:] - 1
    tail[ends] |= word[ends]
    starts, stops = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, stops, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal contents."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    h = (total[stops] - total[starts]) * down[starts]
    return mix(h + (stops - starts).astype(np.uint64) * _M)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the first word's index of every row."""
    starts, stops, rows = spans(data, at)
    return span_hashes(data, starts, stops), rows


def shingles(h: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and their first index of every row.

    A row with fewer words, but some, has its whole sequence as one shingle.
    """
    counts = np.diff(rows)
    n = len(h)
    if n >= size:
        s = h[: n - size + 1].copy()
        for j in range(1, size):
            s *= _P
            s += h[j : n - size + 1 + j]
        s = mix(s)
    else:
        s = np.zeros(0, np.uint64)
    many = counts >= size
    sizes = np.where(many, counts - size + 1, np.minimum(counts, 1))
    out = np.zeros(len(rows), np.int64)
    np.cumsum(sizes, out=out[1:])
    keep = np.zeros(n, bool)
    if many.any():
        keep[_ranges(rows[:-1][many], sizes[many])] = True
    few = np.flatnonzero((counts > 0) & ~many)
    result = np.empty(int(out[-1]), np.uint64)
    where = np.ones(int(out[-1]), bool)
    where[out[few]] = False
    result[where] = s[keep[: len(s)]]
    for r in few:
        x = np.uint64(len(h[rows[r] : rows[r + 1]]))
        for w in h[rows[r] : rows[r + 1]]:
            x = np.uint64((int(x) * int(_P) + int(w)) & _MASK)
        result[out[r]] = mix(np.array([x], np.uint64))[0]
    return result, out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenation of range(start, start + size)."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


ranges = _ranges


NO_ID = -(2**63)  # stands for a null id inside pandas code, where nulls would turn ids into doubles


def held_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.expr(f"cast('{NO_ID}' as long)"))


def given_id(doc_id: Column) -> Column:
    return F.when(doc_id != F.expr(f"cast('{NO_ID}' as long)"), doc_id)


def free_name(columns: list[str], name: str) -> str:
    """The name, with underscores before it until no column begins with it, whatever its case."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = "_" + name
    return name


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null; stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def code_point_key(source: Column) -> Column:
    """Sorts as the text's code points do (UTF-8 bytes have the same order)."""
    return F.hex(F.encode(source, "UTF-8"))
