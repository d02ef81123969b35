"""Near-duplicate passages by compact windows.

Each hash function orders the word shingles of a text. The Cartesian tree of the
hashes has a node for every shingle that is the least of some passage of the
least length; all passages around it up to the next smaller ones on either side
share it as their minimum: a compact window. Windows that share a minimum meet;
where windows of enough hash functions meet in two documents, the intervals are
joined and the passages are verified on their shingles.

Windows of a value that has many don't all meet. They are compared by the shingles
around them instead, until all that have similar passages there are connected.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.text import mix, powers, ranges, shingles, slices, spans, word_hashes
from voxmill.operators.graph import connected_components
from voxmill.session import checkpoint

HASHES, ENOUGH = 4, 2
DRIFT = 32  # words that a passage may be shifted between two windows of one candidate
SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1)) for i in range(16)]
BUCKET, BUCKETS = (1 << 22, 1 << 26), 1000  # characters whose windows one task holds: the first number, the second one beyond so many buckets
FLUSH = 1 << 20  # windows that a task gathers before it sends them
HOT = 16  # members of a class that are linked before the shuffle
FEW, SEVERAL, AHEAD = 16, 128, 16  # classes of a value that all meet; that meet if a code agrees; met in each order beyond that
CODES, CODE_BITS = 6, 5
STEPS = 8  # places looked at on either side of a centre; so many of them in a row have to agree in windows of one run
REACH = 3  # least lengths to either side of a centre whose shingles are compared: a longer similar passage with its shared shingles in one order holds a shorter similar one
BLOCK, CELLS = 4096, 8192  # windows of one value in a block, each of which is compared with each; windows that one task compares at a time


def sliding_minima(g: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value of every run of ``width``, the first of equal ones (in 44 bits).

    Positions have 20 bits; a longer array goes in parts that overlap.
    """
    at = np.uint64((1 << 20) - 1)
    if len(g) < width:
        return np.zeros(0, np.int64)
    if len(g) > 1 << 20:
        step = (1 << 20) - width + 1
        return np.concatenate([lo + sliding_minima(g[lo : lo + (1 << 20)], width) for lo in range(0, len(g) - width + 1, step)])
    m = (g & ~at) | np.arange(len(g), dtype=np.uint64)
    have = 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if width > have:
        m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
    return (m & at).astype(np.int64)


def compact_windows(g: np.ndarray, rows: np.ndarray, width: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, first, last) of the compact windows of at least ``width`` positions, within the rows.

    The centres are the nodes of the Cartesian tree with subtrees of that size; the
    window of a node ends before the nearest smaller nodes to either side, which are
    such nodes themselves. ``least`` are the sliding minima, if they are known.
    """
    none = np.zeros(0, np.int64)
    if len(g) < width:
        return none, none, none
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    least = sliding_minima(g, width) if least is None else least
    least = least[row[: len(least)] == row[width - 1 :]]
    if not len(least):
        return none, none, none
    centre = least[np.concatenate([[True], least[1:] != least[:-1]])]
    first, last = rows[:-1][row[centre]].tolist(), (rows[1:][row[centre]] - 1).tolist()
    value, place, owner = (g[centre] >> np.uint64(20)).tolist(), centre.tolist(), row[centre].tolist()
    stack: list[int] = []
    for k, v in enumerate(value):
        if stack and owner[stack[-1]] != owner[k]:
            stack.clear()
        while stack and value[stack[-1]] > v:
            last[stack.pop()] = place[k] - 1
        if stack:
            first[k] = place[stack[-1]] + 1
        stack.append(k)
    return centre, np.array(first), np.array(last)


# A window: its value, of which the last bits name the hash function, the document, the centre, the
# reach to either side, its look: what stands on either side of the centre, above room for codes that ``partners`` compares; and four bits
# of every shingle that is some steps before it (nearest first, in the upper half) or behind it.
WINDOW = [("value", np.uint64), ("doc", np.int64), ("c", np.int32), ("l", np.int32), ("r", np.int32), ("look", np.uint64), ("around", np.uint64)]
Windows = dict[str, np.ndarray]


def take(w: Windows, at: np.ndarray | slice) -> Windows:
    return {k: x[at] for k, x in w.items()}


def gather(parts: list[Windows]) -> Windows:
    return {k: np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in WINDOW}


def packed(w: Windows) -> bytes:
    """Column by column and byte plane by byte plane, compressed: in sorted windows most planes are nearly constant."""
    value = np.diff(w["value"], prepend=np.uint64(0))
    columns = [value if k == "value" else np.ascontiguousarray(w[k]) for k, _ in WINDOW]
    planes = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> Windows:
    out, at = {}, 0
    raw = np.frombuffer(pa.decompress(data, sum(np.dtype(t).itemsize for _, t in WINDOW) * n, codec="zstd"), np.uint8)
    for k, t in WINDOW:
        size = np.dtype(t).itemsize
        out[k] = np.ascontiguousarray(raw[at : at + size * n].reshape(size, n).T).view(t).ravel()
        at += size * n
    out["value"] = np.cumsum(out["value"], dtype=np.uint64)
    return out


def windows_of(s: np.ndarray, rows: np.ndarray, ids: np.ndarray, width: int, size: int, hashes: int) -> Iterator[Windows]:
    """The compact windows of each row of shingles, by hash function."""
    bits = max(1, (hashes - 1).bit_length())
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    for f in range(hashes):
        c, lo, hi = compact_windows(mix(s ^ SEEDS[f]), rows, width)
        if not len(c):
            continue
        base, end = rows[:-1][row[c]], rows[1:][row[c]]
        before, after = (s[x] >> np.uint64(48) for x in (np.maximum(c - size, base), np.minimum(c + size, end - 1)))
        look = (before << np.uint64(16) | after) << np.uint64(CODES * CODE_BITS)
        around = np.zeros(len(c), np.uint64)
        for away in [-k * step_of(width) for k in range(1, STEPS + 1)] + [k * step_of(width) for k in range(1, STEPS + 1)]:
            at = c + away
            within = (lo <= at) & (at <= hi)  # runs end where the window does
            around = around << np.uint64(4) | np.where(within, s[np.where(within, at, c)] >> np.uint64(60), np.uint64(0))
        value = (mix(s[c]) >> np.uint64(16)) & np.uint64(2**48 - 2**bits) | np.uint64(f)
        yield dict(zip([k for k, _ in WINDOW], [value, ids[row[c]], (c - base).astype(np.int32), (c - lo).astype(np.int32), (hi - c).astype(np.int32), look, around], strict=True))


def step_of(width: int) -> int:
    """Whatever way a passage of ``width`` lies around a centre, it holds STEPS places that are a multiple of this away from it."""
    return max(1, (width - 1) // (STEPS + 1))


def sides(look: np.ndarray) -> np.ndarray:
    """What stands on both sides of the centres."""
    return look >> np.uint64(CODES * CODE_BITS)


def begins(*columns: np.ndarray) -> np.ndarray:
    """Where a value of one of the columns differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def classes(w: Windows) -> tuple[Windows, np.ndarray]:
    """The windows in order, and where the classes begin: the windows of one value with the same on both sides."""
    w = take(w, np.lexsort((w["c"], w["doc"], sides(w["look"]), w["value"])))
    return w, begins(w["value"], sides(w["look"]))


def like(w: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The order by value, what is all around and document, and where those with the same all around begin."""
    all_around = mix(sides(w["look"]) ^ mix(w["around"]))
    order = np.lexsort((w["c"], w["doc"], all_around, w["value"]))
    return order, begins(w["value"][order], all_around[order])


def copies(w: Windows) -> np.ndarray:
    """For each window the first one, by document, that has the same all around."""
    order, start = like(w)
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[start], np.diff(start, append=len(order)))
    return first


def runs_around(w: Windows, before: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that reach ``before`` steps back and the rest of STEPS on, in the order of what stands there and by document;
    where those with the same there begin; and what it is.

    Two windows that hold an equal passage of ``width`` around their centres are together for one ``before`` at least.
    """
    after, step = STEPS - before, step_of(width)
    mask = np.uint64(((1 << 4 * before) - 1 << 64 - 4 * before) | ((1 << 4 * after) - 1 << 32 - 4 * after))
    at = np.flatnonzero((w["l"] >= before * step) & (w["r"] >= after * step))
    run = w["around"][at] & mask
    order = np.lexsort((w["c"][at], w["doc"][at], run, w["value"][at]))
    at, run = at[order], run[order]
    return at, begins(w["value"][at], run), run


def dealt_blocks(w: Windows, key: np.ndarray, buckets: int, other: Windows | None = None) -> Iterator[tuple[int, bool, int, bytes]]:
    """(bucket, links, n, block) of windows, or of pairs of windows, by their keys."""
    key = key % np.uint64(buckets)
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(part):
            both = take(w, part) if other is None else gather([take(w, part), take(other, part)])
            yield int(key[part[0]]), other is not None, len(both["c"]), packed(both)


def window_blocks(docs: DataFrame, width: int, size: int, hashes: int, buckets: int) -> DataFrame:
    """(bucket, links, n, block): the compact windows of every text, packed in blocks by the bucket of their values.

    Many copies in one task are linked there, to the first one. So what a bucket gets
    of copies follows the number of tasks. Links are pairs of windows, dealt by document.
    """

    def flush(parts: list[Windows]) -> Iterator[pa.RecordBatch]:
        w = gather(parts)
        if not len(w["c"]):
            return
        order, start = like(w)
        w, n = take(w, order), np.diff(start, append=len(order))
        first, many = np.repeat(start, n), np.repeat(n, n)
        own = first == np.arange(len(first))
        values = begins(w["value"])
        crowded = np.repeat(np.add.reduceat(own.astype(np.int64), values) >= HOT, np.diff(values, append=len(own)))
        copied = ~own & (crowded | (many >= HOT))
        some = copied & (w["doc"] != w["doc"][first])
        out = list(dealt_blocks(take(w, some), mix(w["doc"][some].astype(np.uint64)), buckets, take(w, first[some])))
        out += dealt_blocks(take(w, ~copied), w["value"][~copied], buckets)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.bool_(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "links", "n", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start, data, at in slices(batch.column(1), 1 << 19):
                s, rows = shingles(*word_hashes(data, at), size)
                for w in windows_of(s, rows, ids[start:], width, size, hashes):
                    parts.append(w)
                    n += len(w["c"])
                if n >= FLUSH:
                    yield from flush(parts)
                    parts, n = [], 0
        yield from flush(parts)

    return docs.mapInArrow(run, "bucket int, links boolean, n int, block binary")


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many codes of two looks are equal."""
    mask = np.uint64(2**CODE_BITS - 1)
    return sum(((x ^ y) >> np.uint64(CODE_BITS * k) & mask) == 0 for k in range(CODES))


def partners(w: Windows, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of windows of one value: every window and its class's first one, and the classes' first ones.

    A class stands for its members, as they meet its first window. If two classes
    begin in one document, the last window of the earlier one is met.
    """
    n = np.diff(start, append=len(w["value"]))
    rep = np.repeat(start, n)
    member = np.flatnonzero(np.arange(len(rep)) > rep)
    yield member, rep[member]
    value = w["value"][start]
    group = np.cumsum(np.concatenate([[False], value[1:] != value[:-1]]))
    size = np.bincount(group, minlength=1)[group] if len(group) else group

    def met(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = np.where(w["doc"][start[i]] == w["doc"][start[j]], start[j] + n[j] - 1, start[j])
        return start[i], other

    for low, high in ((1, FEW), (FEW, SEVERAL)):
        at = np.flatnonzero((size > low) & (size <= high))
        for d in range(1, high):
            k = np.flatnonzero(group[at][d:] == group[at][:-d])
            if not len(k):
                break
            i, j = at[k + d], at[k]
            if low > 1:
                some = agreeing(w["look"][start[i]], w["look"][start[j]]) > 0
                i, j = i[some], j[some]
            yield met(i, j)
    many = np.flatnonzero(size > SEVERAL)
    look = w["look"][start[many]] & np.uint64(2 ** (CODES * CODE_BITS) - 1)
    for turn in range(0, CODES, 2):  # like surroundings stand together in the order of one hash function's codes or another's
        by = np.uint64(turn * CODE_BITS)
        key = look >> by | (look << np.uint64(CODES * CODE_BITS) - by) & np.uint64(2 ** (CODES * CODE_BITS) - 1)
        at = many[np.lexsort((key, group[many]))]
        for d in range(1, AHEAD + 1):
            k = np.flatnonzero(group[at][d:] == group[at][:-d])
            i, j = at[k + d], at[k]
            some = agreeing(w["look"][start[i]], w["look"][start[j]]) > 0
            yield met(i[some], j[some])


def by_number(w: Windows, own: np.ndarray) -> tuple[Windows, np.ndarray]:
    """The windows, but for copies, of values that have FEW of them at most, by value; and where all windows of the other values are."""
    order = np.argsort(w["value"], kind="stable")
    start = begins(w["value"][order]) if len(order) else np.zeros(0, np.int64)
    n = np.add.reduceat(own[order].astype(np.int64), start) if len(order) else start
    many = np.repeat(n > FEW, np.diff(start, append=len(order)))
    return take(w, order[~many & own[order]]), np.sort(order[many])


def all_pairs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with the same key; equal keys stand together."""
    at = np.arange(len(key))
    for d in range(1, len(key)):
        at = at[at >= d]
        at = at[key[at] == key[at - d]]
        if not len(at):
            return
        yield at, at - d


MET = np.dtype([("b", "<i8"), ("a", "<i8"), ("bc", "<i4"), ("bl", "<i4"), ("br", "<i4"), ("ac", "<i4"), ("al", "<i4"), ("ar", "<i4"), ("f", "<i4")])


def meetings(w: Windows, i: np.ndarray, j: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Records of the pairs (i, j) that may hold a passage around their centres, the later document first.

    A passage reaches as far as both windows do, but for what was put in or left out.
    """
    i, j = np.where(w["doc"][i] > w["doc"][j], i, j), np.where(w["doc"][i] > w["doc"][j], j, i)
    reach = lambda k, o: np.minimum(w[k][i], w[k][j] + w[k][j] // 4 + DRIFT // 2) if o else np.minimum(w[k][j], w[k][i] + w[k][i] // 4 + DRIFT // 2)
    found = np.zeros(len(i), MET)
    for name, x in (("b", w["doc"][i]), ("a", w["doc"][j]), ("bc", w["c"][i]), ("ac", w["c"][j]), ("bl", reach("l", 1)), ("br", reach("r", 1)), ("al", reach("l", 0)), ("ar", reach("r", 0)), ("f", w["value"][i] & np.uint64(2**bits - 1))):
        found[name] = x
    return found[(found["b"] != found["a"]) & (np.minimum(found["bl"] + found["br"], found["al"] + found["ar"]) + 1 >= width)]


def pairs_of(found: list[np.ndarray]) -> pa.Table:
    """(b, a, met): the meetings of each pair of documents."""
    m = np.concatenate([np.zeros(0, MET), *found])
    m = m[np.lexsort((m["a"], m["b"]))]
    new = begins(m["b"], m["a"]) if len(m) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(m))[: len(new)]
    rest = np.ascontiguousarray(m[["bc", "bl", "br", "ac", "al", "ar", "f"]].astype(WHERE))
    return pa.table({"b": m["b"][new], "a": m["a"][new], "met": pa.array([rest[p:q].tobytes() for p, q in zip(new, ends, strict=True)], pa.binary())})


UNMET = np.dtype([("value", "<i8"), ("c", "<i4"), ("l", "<i4"), ("r", "<i4")])


def unmet(w: Windows) -> pa.Table:
    """(b, a, met): windows of each document, without a partner."""
    w = take(w, np.argsort(w["doc"], kind="stable"))
    out = np.zeros(len(w["c"]), UNMET)
    for k in ("c", "l", "r"):
        out[k] = w[k]
    out["value"] = w["value"].view(np.int64)
    new = begins(w["doc"]) if len(out) else np.zeros(0, np.int64)
    ends = np.append(new[1:], len(out))[: len(new)]
    return pa.table({"b": w["doc"][new], "a": pa.nulls(len(new), pa.int64()), "met": pa.array([out[p:q].tobytes() for p, q in zip(new, ends, strict=True)], pa.binary())})


def candidates(blocks: DataFrame, width: int, hashes: int, enough: int, buckets: int) -> DataFrame:
    """(b, a, n, b_lo, b_hi, a_lo, a_hi, value, c): passages of two documents, b the later, whose windows meet.

    If a value has more than FEW windows, but for copies, only the copies meet; rows
    without an ``a`` are its windows, with the value and the centre.
    """
    bits = max(1, (hashes - 1).bit_length())

    def meet(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("links", "n", "block")), strict=True))
        w = gather([unpacked(x, n) for links, n, x in rows if not links])
        first = copies(w)
        own = first == np.arange(len(first))
        found = [meetings(w, np.flatnonzero(~own), first[~own], width, bits)]
        few, many = by_number(w, own)
        found += [meetings(few, i, j, width, bits) for i, j in all_pairs(few["value"])]
        for links, n, x in rows:
            if links:
                found.append(meetings(unpacked(x, n), np.arange(n // 2), np.arange(n // 2, n), width, bits))
        return pa.concat_tables([pairs_of(found), unmet(take(w, many[own[many]]))])

    lists = blocks.groupBy("bucket").applyInArrow(meet, "b long, a long, met binary")
    lists = lists.groupBy("b", "a").agg(F.collect_list("met").alias("met"), F.sum(F.length("met")).alias("bytes"))
    return intervals(lists.where(F.col("a").isNull() | (F.col("bytes") >= enough * WHERE.itemsize)), enough)  # fewer windows meet for fewer hash functions


def intervals(lists: DataFrame, enough: int) -> DataFrame:
    """The joined intervals of the meetings of each pair of documents; windows without a partner as they are."""
    names = ["b", "a", "n", "b_lo", "b_hi", "a_lo", "a_hi", "value", "c"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, a, met in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if a is None:
                    w = np.frombuffer(b"".join(met), UNMET)
                    out += [(b, None, n, c - l, c + r, None, None, v, c) for n, (v, c, l, r) in enumerate(w.tolist())]
                else:
                    out += [(b, a, n, *x, None, None) for n, x in enumerate(joined_intervals(np.frombuffer(b"".join(met), WHERE), enough))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 9
            types = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return lists.select("b", "a", "met").mapInArrow(join, "b long, a long, n int, b_lo int, b_hi int, a_lo int, a_hi int, value long, c int")


WHERE = np.dtype([(k, "<i4") for k in ("bc", "bl", "br", "ac", "al", "ar", "f")])


def joined_intervals(met: np.ndarray, enough: int) -> list[tuple[int, int, int, int]]:
    """(b_lo, b_hi, a_lo, a_hi) of the intervals that overlap in both texts with about one shift, if enough hash functions meet there."""
    if len(set(met["f"].tolist())) < enough:
        return []
    shift = met["bc"] - met["ac"]
    met = met[np.argsort(shift, kind="stable")]
    shift.sort()
    band = np.cumsum(np.concatenate([[False], shift[1:] - shift[:-1] > DRIFT]))
    b_lo, b_hi, a_lo, a_hi = met["bc"] - met["bl"], met["bc"] + met["br"], met["ac"] - met["al"], met["ac"] + met["ar"]
    order = np.lexsort((b_lo, band))
    band, b_lo, b_hi, a_lo, a_hi, f = (x[order] for x in (band, b_lo, b_hi, a_lo, a_hi, met["f"]))
    out, begin, high = [], 0, -1
    for k in range(len(band) + 1):
        if k == len(band) or k and (band[k] != band[k - 1] or b_lo[k] > high):
            if len(set(f[begin:k].tolist())) >= enough:
                out.append((int(b_lo[begin:k].min()), int(b_hi[begin:k].max()), int(a_lo[begin:k].min()), int(a_hi[begin:k].max())))
            begin, high = k, -1
        if k < len(band):
            high = max(high, b_hi[k])
    return out


def jaccard(b: np.ndarray, a: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sets of shingles."""
    x, y = _distinct(b), _distinct(a)
    z = np.concatenate([x, y])
    z.sort()
    both = int(np.count_nonzero(z[1:] == z[:-1]))
    return both, len(z) - both


def _distinct(s: np.ndarray) -> np.ndarray:
    """The distinct values in order; for few of them a plain sort is the fastest."""
    s = np.sort(s)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s[new]


def aligned_passages(b: np.ndarray, a: np.ndarray, width: int, percent: int) -> list[tuple[int, int, int, int, int, int]]:
    """(b from, b to, a from, a to, shared, all) of b's longest passages of at least ``width`` shingles that a holds.

    Shared shingles are aligned in chains that ascend in both texts. From one shared
    shingle of a chain to another a passage counts as similar if 100 * shared >=
    percent * all; so many of the longest such passages are taken that they cover
    all of them. A shorter one is lengthened on both sides if it stays similar.
    Of texts that hold the parts in another order, b's own positions are counted,
    too. What is called similar is verified on the sets of both passages; if it
    fails there, its exactly repeated runs of the least length are taken.
    """
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    sorted_ = a[order]
    left = np.searchsorted(sorted_, b)
    i = np.flatnonzero(sorted_[np.minimum(left, len(a) - 1)] == b)
    if len(i) < width * percent // 100:
        return []
    out: set[tuple[int, int, int, int, int, int]] = set()
    right = left + 1
    again = np.flatnonzero(sorted_[1:] == sorted_[:-1])
    if len(again):
        right[i] = np.searchsorted(sorted_, b[i], "right")
    if not len(again) or (right[i] - left[i]).max() == 1:
        j = order[left[i]]
        if len(i) == len(b) >= width and j[-1] - j[0] == len(b) - 1 and (j[1:] > j[:-1]).all():  # all of b in a row
            return [(0, len(b), int(j[0]), int(j[-1]) + 1, len(b), len(b))] if len(_distinct(b)) == len(b) else exact_runs(b, a, 0, len(b) - 1, width)
        aligned = [j]
    else:  # a repeated shingle goes on where the one before it, or after it, is aligned
        out.update(exact_runs(b, a, 0, len(b) - 1, width))
        if any(x[:2] == (0, len(b)) for x in out):  # none is longer
            return sorted(out)
        places = order.tolist()
        first, end = left[i], right[i]
        aligned = [_nearest_places(i, places, first, end), _nearest_places(i[::-1], places, first[::-1], end[::-1])[::-1]]
        if (aligned[0] == aligned[1]).all():
            aligned.pop()
    for j in aligned:
        ranges = [r for at in _chains(j, width * percent // 100) for r in _similar(i[at], j[at], len(b), len(a), width, percent)]
        if (j[1:] <= j[:-1]).any() and len(a) >= width:  # parts in another order are no chain, but the sets may be alike
            for lo, hi, *_ in _similar(i, i, len(b), len(b), width, percent):
                own = j[(i >= lo) & (i < hi)]
                ranges.append((lo, hi, *_lengthened(int(own.min()), int(own.max()) + 1, len(a), width)))
        for b_lo, b_hi, a_lo, a_hi in ranges:
            both, every = jaccard(b[b_lo:b_hi], a[a_lo:a_hi])
            if 100 * both >= percent * every:
                out.add((b_lo, b_hi, a_lo, a_hi, both, every))
            else:
                out.update(exact_runs(b, a, b_lo, b_hi - 1, width))
    return sorted(x for x in out if not any(y[0] <= x[0] and x[1] <= y[1] and (y[0], y[1]) != (x[0], x[1]) for y in out))


def _nearest_places(i: np.ndarray, places: list[int], first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One of the ascending places, from first to end, of each shingle: the nearest to where the shingle before it would go on."""
    first, end, at = first.tolist(), end.tolist(), i.tolist()
    out = [places[k] for k in first]
    for k in range(1, len(out)):
        lo, hi = first[k], end[k]
        if hi - lo > 1:
            want = at[k] + out[k - 1] - at[k - 1]
            n = bisect_left(places, want, lo, hi)
            if n == hi or n > lo and want - places[n - 1] <= places[n] - want:
                n -= 1
            out[k] = places[n]
    return np.array(out)


def _chains(j: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Positions of the longest ascending run of places, then of the longest of the rest, while they have ``least``."""
    rest = np.arange(len(j))
    while len(rest) >= least:
        here = j[rest]
        if (here[1:] > here[:-1]).all():
            yield rest
            return
        tops: list[int] = []
        last: list[int] = []
        before = []
        for k, x in enumerate(here.tolist()):
            n = bisect_left(tops, x)
            before.append(last[n - 1] if n else -1)
            tops[n:], last[n:] = ([x], [k]) if n == len(tops) else ([x, *tops[n + 1 :]], [k, *last[n + 1 :]])
        if len(last) < least:
            return
        chain, k = [], last[-1]
        while k >= 0:
            chain.append(k)
            k = before[k]
        yield rest[chain[::-1]]
        rest = np.delete(rest, chain)


def _similar(i: np.ndarray, j: np.ndarray, n_b: int, n_a: int, width: int, percent: int) -> Iterator[tuple[int, int, int, int]]:
    """(b from, b to, a from, a to) of the longest similar passages of a chain (i, j), which cover all others.

    Each shared shingle adds 100 + percent, and percent is lost for each of either
    passage: the sum is >= 0 if and only if 100 * shared >= percent * all.
    """
    if min(n_b, n_a) < width:
        return
    s = (100 + percent) * np.arange(len(i)) - percent * (i + j)
    need = s - (100 - percent)  # of the last shingle's sum, by the first
    reach = np.maximum.accumulate(s[::-1])  # ascends; the largest sum from each shingle on, backwards
    far = len(i) - 1 - np.searchsorted(reach, need)
    lacks = lambda p, q: np.maximum(width - (i[q] - i[p] + 1), 0) + np.maximum(width - (j[q] - j[p] + 1), 0)
    every = np.arange(len(i))
    short = lacks(every, far) > 0
    far[short & ((100 + percent) * (far - every + 1) < 2 * percent * width)] = -1  # too few, whatever is added
    longer = np.maximum.accumulate(np.where(short, -1, far))
    far[short & (longer >= far)] = -1  # within one that is long enough
    for p in np.flatnonzero(short & (far >= 0)).tolist():
        q = every[p : far[p] + 1]
        fits = np.flatnonzero(s[q] - need[p] >= percent * lacks(p, q))
        far[p] = p + fits[-1] if len(fits) else -1
    best = np.maximum.accumulate(far)
    first = np.searchsorted(best, best)  # the earliest that reaches as far
    u = 0
    while u < len(i):
        q = int(best[u])
        if q < u:
            u += 1
            continue
        p = int(first[u])
        b_lo, b_hi = _lengthened(int(i[p]), int(i[q]) + 1, n_b, width)
        a_lo, a_hi = _lengthened(int(j[p]), int(j[q]) + 1, n_a, width)
        yield b_lo, b_hi, a_lo, a_hi
        u = q + 1


def _lengthened(lo: int, hi: int, n: int, width: int) -> tuple[int, int]:
    """At least ``width`` of n positions around lo to hi."""
    lo = max(0, min(lo, lo - (width - (hi - lo) + 1) // 2)) if hi - lo < width else lo
    hi = max(hi, min(n, lo + width))
    return min(lo, max(0, hi - width)), hi


def exact_runs(b: np.ndarray, a: np.ndarray, lo: int, hi: int, width: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of at least ``width`` of b's positions lo to hi that a repeats exactly; they cover all positions of such runs.

    From where a run ends, the next one begins as late as it still joins on.
    """
    b = b[lo : hi + 1]
    if min(len(b), len(a)) < width:
        return []
    in_b, in_a = _run_hashes(b, width), _run_hashes(a, width)
    order = np.argsort(in_a, kind="stable")
    at = np.searchsorted(in_a[order], in_b)
    hits = np.flatnonzero(in_a[order[np.minimum(at, len(order) - 1)]] == in_b)
    out, k = [], 0
    while k < len(hits):
        i = int(hits[k])
        j = int(order[at[i]])
        n = min(len(b) - i, len(a) - j)
        differs = np.flatnonzero(b[i : i + n] != a[j : j + n])
        n = int(differs[0]) if len(differs) else n
        if n >= width:
            both, every = jaccard(b[i : i + n], a[j : j + n])
            out.append((lo + i, lo + i + n, j, j + n, both, every))
        k = max(k + 1, int(np.searchsorted(hits, i + n, "right")) - 1)
        if k < len(hits) and hits[k] + width <= i + n:
            k += 1
    return out


def _run_hashes(s: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` values."""
    up, down = powers(len(s) + 1)
    total = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s.astype(np.uint64)) * up[: len(s)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[: len(s) - width + 1])


PIECES = 256  # passages asked of a text at once


def _asked(found: DataFrame, of: str, by: str, columns: list[str]) -> DataFrame:
    """(doc_id, part, asked): what is asked of each document, dealt to parts, as one document may be asked by very many."""
    counts = found.groupBy(of).agg(F.ceil(F.count("*") / PIECES).alias("parts"))
    part = F.pmod(F.xxhash64(by), F.col("parts")).alias("part")
    dealt = found.join(counts, of).select(F.col(of).alias("doc_id"), part, F.struct(*columns).alias("q"))
    return dealt.groupBy("doc_id", "part").agg(F.collect_list("q").alias("asked"))


def repeated_passages(docs: DataFrame, words: int = 50, size: int = 5, percent: int = 75, hashes: int = HASHES, enough: int = ENOUGH, every: bool = False) -> DataFrame:
    """(doc_id, start, end, source_id, source_start, source_end, shared, shingles): passages that an earlier document has too.

    Reads doc_id and text; other columns are ignored. Positions are words, ends
    exclusive; passages have at least ``words`` words and share at least ``percent``
    of the shingles of both. The later document is the one of larger doc_id. Windows
    that have the same all around meet the first of them, which stands for the others.
    All windows of a value with at most FEW meet. Those of one with more are compared by
    the shingles they share, wherever they aren't in one group of passages yet: until all
    that have similar passages around them are connected, or, if ``every`` one is asked
    for, each with each of another group. So a passage may stand only as the source of later
    ones of its group. Null and short texts, and rows with a null
    doc_id, have no passages. Rows that repeat a doc_id aren't compared with each
    other. An empty table gives no rows.
    """
    width = words - size + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    buckets = -(-chars // min(BUCKET[1], max(BUCKET[0], chars // BUCKETS))) or 1
    met = checkpoint(candidates(window_blocks(texts, width, size, hashes, buckets), width, hashes, enough, buckets))
    found, crowd = (met.where(x) for x in ("a is not null", "a is null"))
    out = verified(texts, found, size, width, percent)
    if crowd.isEmpty():
        return out
    out = checkpoint(out)
    left = checkpoint(compared(texts, unlinked(crowd, out, words, size, hashes), size, width, percent, hashes, every))
    return out if left.isEmpty() else out.union(verified(texts, left, size, width, percent)).distinct()


def unlinked(crowd: DataFrame, found: DataFrame, words: int, size: int, hashes: int) -> DataFrame:
    """(doc_id, value, label, parts, c, b_lo, b_hi): windows of values whose windows aren't all in one group of passages.

    A value names no hash function any more: the windows of one place are one.

    The label is that of the group of the passages around the centre, or else the
    document's own; windows of one label are linked.
    """
    nodes, _, components = passage_nodes(found, words)
    places = nodes.join(components, "node").select("doc_id", "start", "end", "component")
    value = F.col("value").bitwiseAND(F.lit(-(1 << max(1, (hashes - 1).bit_length()))))  # a place may be the least of several hash functions
    windows = crowd.select(F.col("b").alias("doc_id"), value.alias("value"), "c", "b_lo", "b_hi").groupBy("doc_id", "c", "value").agg(F.min("b_lo").alias("b_lo"), F.max("b_hi").alias("b_hi"))
    inside = (windows.doc_id == places.doc_id) & (places.start <= windows.c) & (places.end >= windows.c + size)
    labels = windows.join(places, inside).groupBy(windows.doc_id, "c").agg(F.min("component").alias("label"))
    windows = checkpoint(windows.join(labels, ["doc_id", "c"], "left").withColumn("label", F.coalesce("label", F.xxhash64("doc_id", F.lit("alone")))))
    mixed = windows.groupBy("value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    return windows.join(mixed.select("value", "parts"), "value").select("doc_id", "value", "label", "parts", "c", "b_lo", "b_hi")


def least_shared(s: np.ndarray, c: int, width: int, percent: int) -> int:
    """So many distinct shingles at least are shared by a passage of ``width`` or more around place c and one that is similar."""
    order = np.argsort(s, kind="stable")
    before = np.full(len(s), -1)  # the place of the same shingle before
    again = np.flatnonzero(s[order][1:] == s[order][:-1])
    before[order[again + 1]] = order[again]
    begin = np.arange(max(0, c - width + 1), min(c, len(s) - width) + 1)
    distinct = (np.lib.stride_tricks.sliding_window_view(before, width)[begin] < begin[:, None]).sum(1)
    return -(-percent * int(distinct.min()) // 100)


def compared(texts: DataFrame, crowd: DataFrame, size: int, width: int, percent: int, hashes: int, every: bool = True) -> DataFrame:
    """The candidates among windows of one value and different labels: all pairs that share as many shingles as a similar passage takes.

    Unless ``every`` one is asked for, only as many as connect what they all connect: see ``connecting``.
    The windows of a value are compared block against block, so a task gets a part of a very common value's.
    """
    bits = max(1, (hashes - 1).bit_length())
    reach, whole = REACH * width, -(-percent * width // 100)
    asked = crowd.groupBy("doc_id").agg(F.collect_list(F.struct("value", "label", "parts", "c", "b_lo", "b_hi")).alias("asked"))
    names = ["doc", "value", "label", "parts", "c", "l", "r", "least", "held"]
    types = [pa.int64()] * 3 + [pa.int32()] * 5 + [pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, inner = batch.column(2).offsets.to_numpy(), batch.column(2).values
            value, label, parts, c, lo, hi = (inner.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            for first, data, at in slices(batch.column(1)):
                s, rows = shingles(*word_hashes(data, at), size)
                names_ = (mix(s) >> np.uint64(16)) & np.uint64(2**48 - 2**bits)
                short = (s >> np.uint64(32)).astype(np.uint32)
                out = []
                for i in range(len(rows) - 1):
                    base, n = int(rows[i]), int(rows[i + 1] - rows[i])
                    again = len(_distinct(short[base : base + n])) < n
                    for k in range(int(ends[first + i]), int(ends[first + i + 1])):
                        x = int(c[k])
                        if hi[k] >= n or int(names_[base + x]) != int(value[k]) & ((1 << 64) - 2**bits):  # of another text with this doc_id
                            continue
                        p, q = max(int(lo[k]), x - reach), min(int(hi[k]), x + reach) + 1
                        held = short[base + p : base + q]
                        least = least_shared(held, x - p, width, percent) if again else whole
                        out.append((batch.column(0)[first + i].as_py(), value[k], label[k], parts[k], x, x - lo[k], hi[k] - x, least, held.tobytes()))
                cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

    held = texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(cut, "doc long, value long, label long, parts int, c int, l int, r int, least int, held binary")
    own = F.pmod(F.xxhash64("doc", "c"), "parts").cast("int")
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.expr("sequence(0, parts - 1)"))
    cells = held.withColumn("own", own).withColumn("other", F.explode(others)).drop("parts")
    count = crowd.agg(F.sum("parts")).first()[0] or 0
    key = F.xxhash64("value", F.least("own", "other"), F.greatest("own", "other"))
    cells = cells.withColumn("cell", key).withColumn("bucket", F.pmod("cell", F.lit(-(-count // CELLS) or 1)))

    def meet(table: pa.Table) -> pa.Table:
        get = lambda k: table.column(k).to_numpy()
        held = [np.frombuffer(x, np.uint32) for x in table.column("held").to_pylist()]
        w = {"value": get("value").astype(np.int64).view(np.uint64), **{k: get(k) for k in ("doc", "c", "l", "r")}}
        found, own, other = [], get("own"), get("other")
        if not every:
            i, j = connecting(get("cell"), get("label"), get("doc"), np.where(own == other, -1 - np.arange(len(own)), own), np.minimum(w["l"], reach), get("least"), held, width, percent)
            return pairs_of([meetings(w, i, j, width, bits)])
        for i, j in sharing(get("cell"), get("label"), get("least"), held):
            some = (own[i] != own[j]) | (own[i] == other[i])
            found.append(meetings(w, i[some], j[some], width, bits))
        return pairs_of(found)

    lists = cells.groupBy("bucket").applyInArrow(meet, "b long, a long, met binary").groupBy("b", "a").agg(F.collect_list("met").alias("met"))
    return intervals(lists, 1)


def holders_of(cell: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, row, place), each row's values once and by value; values of different cells differ."""
    m, n = len(held), np.array([len(x) for x in held], np.int64)
    row = np.repeat(np.arange(m), n)
    g = np.concatenate([np.zeros(0, np.uint32), *held]).astype(np.uint64)
    g = np.unique(mix(g ^ mix(cell.view(np.uint64)[row])), return_inverse=True)[1]
    places = int(n.max(initial=1))
    both = np.sort((g * m + row) * places + ranges(np.zeros(m, np.int64), n))
    place, both = both % places, both // places
    new = begins(both) if len(both) else np.zeros(0, np.int64)
    return both[new] // max(1, m), both[new] % max(1, m), place[new]


def of_several(g: np.ndarray, row: np.ndarray, least: np.ndarray, *labels: np.ndarray) -> np.ndarray:
    """Where values are that several of all labels hold, and rows that hold enough of these."""
    at = np.arange(len(g))
    while len(at):
        start = begins(g[at])
        shared = np.logical_and.reduce([np.minimum.reduceat(x[row[at]], start) != np.maximum.reduceat(x[row[at]], start) for x in labels])
        keep = np.repeat(shared, np.diff(start, append=len(at)))
        keep &= (np.bincount(row[at][keep], minlength=len(least)) >= least)[row[at]]
        if keep.all():
            break
        at = at[keep]
    return at


Rows = dict[str, np.ndarray]


def by_rows(g: np.ndarray, row: np.ndarray, m: int, place: np.ndarray | None = None) -> Rows:
    """The values row by row, in order, where each row's begin, how many there are, and row and value in one number."""
    by = np.argsort(row, kind="stable")
    g, row = g[by], row[by]
    kinds = int(g.max(initial=0)) + 1
    own = {"row": row, "g": g, "start": np.searchsorted(row, np.arange(m)), "n": np.bincount(row, minlength=m), "known": row * kinds + g, "kinds": np.int64(kinds)}
    return own if place is None else own | {"place": place[by]}


def looked_up(own: Rows, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, at, there, hit): the values of the rows i, where they would be among those of j, and whether they are."""
    pair, at = np.repeat(np.arange(len(i)), own["n"][i]), ranges(own["start"][i], own["n"][i])
    asked = j[pair] * own["kinds"] + own["g"][at]
    there = np.minimum(np.searchsorted(own["known"], asked), len(own["known"]) - 1)
    return pair, at, there, own["known"][there] == asked


def common(own: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values both rows of each pair hold."""
    out = np.zeros(len(i), np.int64)
    for lo in range(0, len(i), 1 << 12):
        one, two = i[lo : lo + (1 << 12)], j[lo : lo + (1 << 12)]
        less = own["n"][one] < own["n"][two]
        pair, _, _, hit = looked_up(own, np.where(less, one, two), np.where(less, two, one))
        out[lo : lo + (1 << 12)] = np.bincount(pair[hit], minlength=len(one))
    return out


def sharing(cell: np.ndarray, label: np.ndarray, least: np.ndarray, held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one cell and different labels that share as many values as both need at least."""
    g, row, _ = holders_of(cell, held)
    at = of_several(g, row, least, label)
    own = by_rows(g[at], row[at], len(held))
    for i, j in rare_pairs(g[at], row[at], least, label):
        enough = common(own, i, j) >= np.maximum(least[i], least[j])
        yield i[enough], j[enough]


def rare_pairs(g: np.ndarray, row: np.ndarray, least: np.ndarray, *labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that differ in all labels and may share as many values as both need at least.

    Of two that share enough, the rarest values of each, but for as many less one,
    have one in common.
    """
    if not len(g):
        return
    m, holders = len(least), np.bincount(g)
    order = np.lexsort((g, holders[g], row))
    g, row = g[order], row[order]
    start, n = np.searchsorted(row, np.arange(m)), np.bincount(row, minlength=m)
    rare = np.flatnonzero(np.arange(len(row)) - start[row] <= (n - least)[row])
    rare = rare[np.argsort(g[rare], kind="stable")]
    code, many = [np.zeros(0, np.int64)], 0
    for one, two in all_pairs(g[rare]):
        i, j = row[rare[one]], row[rare[two]]
        some = np.logical_and.reduce([x[i] != x[j] for x in labels])
        code.append(_distinct(np.maximum(i, j)[some] * m + np.minimum(i, j)[some]))
        many += len(code[-1])
        if many > 1 << 22:
            code = [_distinct(np.concatenate(code))]
            many = 0
    code = _distinct(np.concatenate(code))
    for lo in range(0, len(code), 1 << 12):
        yield code[lo : lo + (1 << 12)] // m, code[lo : lo + (1 << 12)] % m


def dense(own: Rows, i: np.ndarray, j: np.ndarray, centre: np.ndarray, size: np.ndarray, width: int, percent: int) -> np.ndarray:
    """Whether ``width`` places or more around the centres of rows i and j may be similar; neither row has repeats.

    What is similar shares at least ``percent`` of
    (100 + percent) of both passages' sizes. If the shared values stand in one order, a passage
    of j is as long as their places there are apart; else it is only known to have ``width``.
    """
    place, row = own["place"], own["row"]
    reach, whole = int(max(centre.max(), (size - centre).max())), 100 + percent
    begin, away = np.arange(reach + 1), np.arange(-reach, reach + 1, dtype=np.int32)
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 9):
        one, two = i[lo : lo + (1 << 9)], j[lo : lo + (1 << 9)]
        pair, at, there, hit = looked_up(own, one, two)
        spot = pair[hit], (place[at] - centre[row[at]] + reach)[hit]
        held = np.zeros((len(one), len(away)), bool)
        held[spot] = True
        other = np.full(held.shape, -1, np.int32)
        other[spot] = place[there[hit]]
        upto = np.zeros((len(one), len(away) + 1), np.int32)
        np.cumsum(held, axis=1, out=upto[:, 1:])
        ordered = ~(held[:, 1:] & (other[:, 1:] <= np.maximum.accumulate(other, axis=1)[:, :-1])).any(1)
        # in order: from a shared place up to the centre to one from there on; or so many in one shortest passage
        low = 1 << 28
        score = whole * upto[:, 1:] - percent * (away + other)
        best = np.maximum.accumulate(np.where(held, score, np.int32(-low))[:, ::-1], axis=1)[:, ::-1]
        far = np.maximum(reach, begin + width - 1)
        inside = far < len(away)
        first = np.where(held, score - whole, np.int32(low))[:, begin[inside]]
        good = (best[:, far[inside]] - first).max(1, initial=-low) >= 2 * percent
        end = np.clip(np.arange(reach + 1, reach + width + 1), 0, len(away))
        good |= whole * (upto[:, end] - upto[:, np.maximum(end - width, 0)]).max(1) >= 2 * percent * width
        # in whatever order
        for k in np.flatnonzero(~ordered).tolist():
            row_ = int(one[k])
            p, q = reach - int(centre[row_]), reach + int(size[row_] - centre[row_])
            total = whole * upto[k, p : q + 1] - percent * np.arange(q - p + 1)
            best_ = np.maximum.accumulate(total[::-1])[::-1]
            to = np.maximum(centre[row_] + 1, np.arange(centre[row_] + 1) + width)
            to = to[to < len(total)]
            good[k] = len(to) > 0 and (best_[to] - total[: len(to)]).max() >= percent * width
        out[lo : lo + (1 << 9)] = good
    return out


def connecting(cell: np.ndarray, label: np.ndarray, doc: np.ndarray, side: np.ndarray, centre: np.ndarray, least: np.ndarray, held: list[np.ndarray], width: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell and two sides with similar passages around their centres, which connect all that any such pairs connect.

    Rows of one label are connected, unless one document has them all. Each row is
    first asked about the one that it shares most values with among those next to it,
    as long as this connects more. Then all pairs that aren't connected yet and share
    enough are asked. So there are fewer pairs than rows, whatever the groups' sizes.
    """
    m, found = len(held), []
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell = np.unique(cell, return_inverse=True)[1]
    group = np.unique(mix(label.astype(np.int64).view(np.uint64) ^ mix(cell.astype(np.uint64))), return_inverse=True)[1]
    docs = np.unique(doc, return_inverse=True)[1]
    low, high = np.full(m, m), np.full(m, -1)
    np.minimum.at(low, group, docs)
    np.maximum.at(high, group, docs)
    first = np.full(m, m)
    np.minimum.at(first, group, np.arange(m))
    up = np.where((low == high)[group], np.arange(m), first[group])
    # two sets of so many share (percent of) what both have, so at least this part of their sizes' sum
    size = (least.astype(np.int64) - 1) * 100 // percent + 1
    smallest = np.full(m, np.iinfo(np.int64).max)
    np.minimum.at(smallest, cell, size)
    least = np.maximum(least, -(-percent * (size + smallest[cell]) // (100 + percent)))
    g, row, place = holders_of(cell, held)
    long = np.array([len(x) for x in held])
    unlike = np.bincount(row, minlength=m) == long  # rows without repeats

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs share enough, and around both centres, as far as this can be told without an alignment."""
        at = np.flatnonzero(common(own, i, j) >= np.maximum(least[i], least[j]))
        told = unlike[i[at]] & unlike[j[at]]
        told[told] = ~dense(own, i[at][told], j[at][told], centre, long, width, percent)
        return at[~told]

    def tops() -> np.ndarray:
        nonlocal up
        while (up[up] != up).any():
            up = up[up]
        return up

    def top(x: int) -> int:
        while up[x] != x:
            x = int(up[x])
        return x

    def alike(a: int, b: int) -> bool:
        """Whether the least length around both centres is the same."""
        before = min(centre[a], centre[b])
        p, q = centre[a] - before, centre[b] - before
        n = min(long[a] - p, long[b] - q)
        differs = np.flatnonzero(held[a][p : p + n] != held[b][q : q + n])
        k = int(np.searchsorted(differs, before))
        return (differs[k] if k < len(differs) else n) - (differs[k - 1] if k else -1) > width

    def ask(i: np.ndarray, j: np.ndarray) -> int:
        before, group = len(found), tops()
        some = group[i] != group[j]
        i, j = np.where(docs[i] < docs[j], i, j)[some], np.where(docs[i] < docs[j], j, i)[some]
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            p, q = top(a), top(b)
            if p != q and (alike(a, b) or any(x[0] <= centre[b] < x[1] and x[2] <= centre[a] < x[3] for x in aligned_passages(held[b], held[a], width, percent))):
                up[max(p, q)] = min(p, q)
                found.append((a, b))
        return len(found) - before

    tried, more = np.zeros(0, np.int64), 1
    while more:
        group = tops()
        at = of_several(g, row, least, group, docs, side)
        g, row, place = g[at], row[at], place[at]
        own = by_rows(g, row, m, place)
        k = np.flatnonzero(g[1:] == g[:-1])
        k = k[np.logical_and.reduce([x[row[k]] != x[row[k + 1]] for x in (group, docs, side)])]
        code, n = np.unique(row[k] * m + row[k + 1], return_counts=True)
        new = ~np.isin(code, tried)
        code, n = code[new], n[new]
        order = np.argsort(-n, kind="stable")
        code = code[order]
        code = code[np.unique(np.concatenate([np.unique(code // m, return_index=True)[1], np.unique(code % m, return_index=True)[1]]))]
        if not len(code):
            break
        tried = np.concatenate([tried, code])
        code = code[near(code // m, code % m)]
        more = ask(code // m, code % m)
    for i, j in rare_pairs(g, row, least, tops(), docs, side):
        some = ~np.isin(i * m + j, tried) & ~np.isin(j * m + i, tried)
        some &= tops()[i] != tops()[j]
        i, j = i[some], j[some]
        at = near(i, j)
        ask(i[at], j[at])
    i, j = np.array(found, np.int64).reshape(-1, 2).T
    return i, j


def verified(texts: DataFrame, found: DataFrame, size: int, width: int, percent: int) -> DataFrame:
    """The passages of candidates that are similar."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2)
            for first, data, at in slices(batch.column(1)):
                starts, stops, rows = spans(data, at)
                out, bytes_ = [], 0
                for i in range(len(rows) - 1):
                    made: dict[tuple[int, int], tuple[int, bytes]] = {}
                    for q in asked[first + i].as_py():
                        w0, w1 = rows[i] + q["a_lo"], min(rows[i] + q["a_hi"] + size, rows[i + 1])
                        if w0 >= w1:  # of another text with this doc_id
                            continue
                        if (w0, w1) not in made:
                            piece = data[starts[w0] : stops[w1 - 1]].tobytes()
                            made[w0, w1] = len(piece), pa.compress(piece, codec="zstd", asbytes=True)
                        out.append((q["b"], batch.column(0)[first + i].as_py(), q["b_lo"], q["b_hi"], q["a_lo"], *made[w0, w1]))
                        bytes_ += len(out[-1][-1])
                        if bytes_ > 1 << 22:
                            yield _pieces(out)
                            out, bytes_ = [], 0
                yield _pieces(out)

    pieces = texts.join(_asked(found, "a", "b", ["b", "b_lo", "b_hi", "a_lo", "a_hi"]), "doc_id").select("doc_id", "text", "asked").mapInArrow(cut, PIECE)
    whole = F.struct("a", "b_lo", "b_hi", "a_lo", "bytes", "piece")
    # a text meets its pieces in parts, by the earlier document
    dealt = pieces.repartition("b").groupBy(F.col("b").alias("doc_id"), F.pmod(F.xxhash64("a"), F.lit(16)).alias("part")).agg(F.collect_list(whole).alias("asked"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in slices(batch.column(1)):
                s, rows = shingles(*word_hashes(data, at), size)
                asked = [(i, q) for i in range(len(rows) - 1) for q in batch.column(2)[first + i].as_py()]
                out = []
                for lo in range(0, len(asked), 500):
                    part = asked[lo : lo + 500]
                    held = pa.array([pa.decompress(q["piece"], q["bytes"], codec="zstd", asbytes=True) for _, q in part], pa.large_binary()).cast(pa.large_string())
                    for one, data_a, at_a in slices(held):
                        s_a, rows_a = shingles(*word_hashes(data_a, at_a), size)
                        for k, (i, q) in enumerate(part[one : one + len(rows_a) - 1]):
                            x = s[rows[i] + q["b_lo"] : min(rows[i] + q["b_hi"] + 1, rows[i + 1])]
                            y = s_a[rows_a[k] : rows_a[k + 1]]
                            for p in aligned_passages(x, y, width, percent) if len(x) and len(y) else ():
                                out.append((batch.column(0)[first + i].as_py(), q["b_lo"] + p[0], q["b_lo"] + p[1] + size - 1, q["a"], q["a_lo"] + p[2], q["a_lo"] + p[3] + size - 1, p[4], p[5]))
                cols = list(zip(*out, strict=True)) if out else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=NAMES)

    return texts.join(dealt, "doc_id").select("doc_id", "text", "asked").mapInArrow(check, ", ".join(f"{n} long" for n in NAMES)).distinct()


def passage_groups(found: DataFrame, words: int = 50) -> DataFrame:
    """The rows of ``found`` with group_id and group_start: the first passage that can be reached through similar ones.

    A document's passages that overlap by half the least length count as one. So
    copies needn't be expanded into all pairs: those of one group belong together.
    """
    nodes, links, components = passage_nodes(found, words)
    first = components.join(nodes, "node").groupBy("component").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    # documents link to earlier ones, so every node has an edge
    placed = links.join(components, "node").join(first, "component")
    return placed.select(*NAMES, F.col("first.doc_id").alias("group_id"), F.col("first.start").alias("group_start"))


def passage_nodes(found: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages with their nodes, the rows of ``found`` with both nodes, and the components of nodes."""
    ends = found.select("doc_id", "start", "end").union(found.select("source_id", "source_start", "source_end")).distinct()
    order = "over (partition by doc_id order by start, end"
    ahead = ends.withColumn("far", F.expr(f"max(end) {order} rows between unbounded preceding and 1 preceding)"))
    nodes = ahead.withColumn("n", F.expr(f"count_if(far is null or start > far - {words // 2}) {order})"))
    nodes = checkpoint(nodes.select("doc_id", "start", "end", F.xxhash64("doc_id", "n").alias("node")))
    source = nodes.toDF("source_id", "source_start", "source_end", "source")
    links = checkpoint(found.join(nodes, ["doc_id", "start", "end"]).join(source, ["source_id", "source_start", "source_end"]))
    return nodes, links, connected_components(links, "node", "source")


NAMES = ["doc_id", "start", "end", "source_id", "source_start", "source_end", "shared", "shingles"]
PIECE = "b long, a long, b_lo int, b_hi int, a_lo int, bytes int, piece binary"


def _pieces(out: list[tuple]) -> pa.RecordBatch:
    parts = list(zip(*out, strict=True)) if out else [[]] * 7
    types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(parts, types, strict=True)], names=["b", "a", "b_lo", "b_hi", "a_lo", "bytes", "piece"])
