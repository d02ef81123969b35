"""Line dedup by pairwise alignment.

A line that several documents hold names partners, and so does a run of adjacent
lines with enough characters for a block: a rare one all its holders, any other
the first document that holds it. Each pair is aligned by patience diff, and
blocks of aligned lines are deleted from the later document. A run that stays
undeleted, as it crosses other lines in the alignment, goes on to its next
earlier holders, until it is deleted once or has met them all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.text import free_name, mix, powers
from voxmill.session import checkpoint

RARE = 4
MIN_CHARS = 40
CELLS = 1 << 26  # bits of a table of common subsequences that are held at a time


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each line of a, b's places as bits: 0 where the longest common subsequence with b's lines up to it grows."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = v = (1 << len(b)) - 1
    for x in a:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of a with the first 0, 1, ... lines of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007  the last one counts
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8), "little"), np.uint8), count=len(b), bitorder="little")
    return np.concatenate([[0], np.cumsum(bits == 0)])


def subsequence(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence as positions (in a, in b). Long parts are halved first, so memory stays bounded."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        x, y = a[a0:a1], b[b0:b1]
        if not x or not y:
            continue
        if len(x) > 1 and len(x) * len(y) > CELLS:
            half = len(x) // 2
            cut = int(np.argmax(_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]))
            todo += [(a0, a0 + half, b0, b0 + cut), (a0 + half, a1, b0 + cut, b1)]
            continue
        rows, i, j = list(_rows(x, y)), len(x), len(y)
        while i and j:
            if x[i - 1] == y[j - 1]:
                i, j = i - 1, j - 1
                out.append((a0 + i, b0 + j))
            elif rows[i - 1] >> j - 1 & 1:
                j -= 1
            else:
                i -= 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b) of equal lines, both ascending.

    Common starts and ends are aligned first; then the lines that occur once in
    either part, in their longest common order; then what lies between them. A part
    in which no common line occurs once is aligned by a longest common subsequence.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {a[i]: i for i in range(a0, a1) if in_a[a[i]] == 1}
        unique = [(at[b[j]], j) for j in range(b0, b1) if in_b[b[j]] == 1 and b[j] in at]
        tops: list[int] = []  # smallest last position in a of each length
        last: list[int] = []
        before = []
        for k, (i, _) in enumerate(unique):
            n = bisect_left(tops, i)
            before.append(last[n - 1] if n else -1)
            tops[n:], last[n:] = ([i], [k]) if n == len(tops) else ([i, *tops[n + 1 :]], [k, *last[n + 1 :]])
        chain, k = [], last[-1] if last else -1
        while k >= 0:
            chain.append(unique[k])
            k = before[k]
        end = (a1, b1)
        for i, j in chain:
            todo.append((i + 1, end[0], j + 1, end[1]))
            out.append((i, j))
            end = (i, j)
        if chain:
            todo.append((a0, end[0], b0, end[1]))
        else:
            common = [[k for k in range(lo, hi) if x[k] in other] for x, lo, hi, other in ((a, a0, a1, in_b), (b, b0, b1, in_a))]
            out += [(common[0][i], common[1][j]) for i, j in subsequence(*([x[k] for k in own] for x, own in zip((a, b), common, strict=True)))]
    return sorted(out)


def common_blocks(a: list[int], b: list[int], chars: list[int], least: int) -> list[int]:
    """The lines of b in aligned blocks of at least ``least`` characters."""
    out: list[int] = []
    block: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if sum(chars[x] for x in block) >= least:
                out += block
            block = []
        block.append(j)
        before = (i, j)
    return out


def _key(text: Column) -> Column:
    """Documents are told apart by id and text, and ordered by both."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text"))


def line_runs(hashes: np.ndarray, chars: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, key) of the shortest runs of at least ``least`` characters from, and up to, each line that isn't blank.

    ``sizes`` has the documents' numbers of lines. Each line of a block of that many
    characters is in such a run within the block. The key of a single line is its hash.
    """
    least = max(least, 1)
    total = np.concatenate([[0], np.cumsum(chars.astype(np.int64))])
    at = np.flatnonzero(chars > 0)
    ends = np.repeat(np.cumsum(sizes), sizes)[at]
    starts = ends - np.repeat(sizes, sizes)[at]
    last = np.searchsorted(total, total[at] + least) - 1
    first = np.searchsorted(total, total[at + 1] - least, "right") - 1
    down_, up_ = last < ends, first >= starts
    both = np.unique(np.stack([np.concatenate([at[down_], first[up_]]), np.concatenate([last[down_], at[up_]])]), axis=1)
    first, last = both[0], both[1]
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes.view(np.uint64)) * up[: len(hashes)], out=sums[1:])
    key = mix((sums[last + 1] - sums[first]) * down[first] + (last - first).astype(np.uint64)).view(np.int64)
    return first, last, np.where(first == last, hashes[first], key)


def _run_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(d, h): the keys of the runs of several lines of each (d, hashes, chars)."""
    for batch in batches:
        for lo in range(0, len(batch), 1000):
            part = batch.slice(lo, 1000)
            sizes = np.diff(part.column(1).offsets.to_numpy())
            hashes, chars = (part.column(i).flatten().to_numpy().copy() for i in (1, 2))
            first, last, key = line_runs(hashes, chars, sizes, least)
            many = first < last
            row = np.repeat(np.arange(len(part)), sizes)[first[many]]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(key[many])], names=["d", "h"])


def _align(pairs: DataFrame, lines: DataFrame, min_chars: int) -> DataFrame:
    """(d, lines): the lines of d in blocks aligned with any e of the pairs (d, e)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, chars = (batch.column(i).to_pylist() for i in (1, 2, 3))
            found = [common_blocks(*x, min_chars) for x in zip(a, b, chars, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["d", "found"])

    both = pairs.join(lines.select(F.col("d").alias("e"), F.col("hashes").alias("a")), "e").join(lines, "d").select("d", "a", F.col("hashes").alias("b"), "chars")
    aligned = both.mapInArrow(run, f"d {KEY}, found array<int>").where(F.size("found") > 0)
    return aligned.groupBy("d").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("lines"))


def _undeleted(asked: DataFrame, lines: DataFrame, found: DataFrame, min_chars: int) -> DataFrame:
    """(d, h): those of the asked keys of runs that have no occurrence among the found lines of their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for x, (ask, gone) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                hashes, chars = (batch.column(i)[x].values.to_numpy().copy() for i in (2, 3))
                first, last, key = line_runs(hashes, chars, np.array([len(hashes)]), min_chars)
                stays = np.ones(len(hashes) + 1, np.int64)
                stays[len(hashes)] = 0
                stays[gone or []] = 0
                left = np.concatenate([[0], np.cumsum(stays)])
                deleted = set(key[left[last + 1] == left[first]].tolist())
                more = [k for k in set(ask) & set(key.tolist()) if k not in deleted]
                rows += [x] * len(more)
                keys += more
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(keys, pa.int64())], names=["d", "h"])

    asks = asked.groupBy("d").agg(F.collect_list("h").alias("ask"))
    return asks.join(lines, "d").join(found, "d", "left").select("d", "ask", "hashes", "chars", "lines").mapInArrow(run, f"d {KEY}, h long")


KEY = "struct<doc_id:long,text:long>"


def common_lines(docs: DataFrame, rare: int = RARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, lines): for each document the 0-based lines that an earlier one already has, in aligned blocks."""
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x))  # a function of two would get the position, too
    lines = docs.where(F.col("text").isNotNull()).select(_key(F.col("text")).alias("d"), trimmed.alias("t"))
    lines = lines.select("d", F.transform("t", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("t", F.length).alias("chars"))
    lines = checkpoint(lines.dropDuplicates(["d"]))
    single = lines.select("d", F.explode(F.arrays_zip("hashes", "chars")).alias("x")).where("x.chars > 0").select("d", F.col("x.hashes").alias("h"))
    seen = single.union(lines.select("d", "hashes", "chars").mapInArrow(lambda batches: _run_keys(batches, min_chars), f"d {KEY}, h long")).distinct()
    # the first holder and the number of holders are gathered before the shuffle; only shared keys go on
    shared = seen.groupBy("h").agg(F.min("d").alias("first"), F.count("*").alias("holders")).where("holders > 1")
    holds = checkpoint(seen.join(shared, "h"))
    pairs = holds.where(F.col("d") != F.col("first")).select("d", F.col("first").alias("e"))
    few = holds.where((F.col("holders") > 2) & (F.col("holders") <= rare))
    by_age = Window.partitionBy("h").orderBy("d")
    earlier = few.withColumn("earlier", F.collect_list("d").over(by_age.rowsBetween(-rare, -1)))
    pairs = pairs.union(earlier.select("d", F.explode("earlier").alias("e"))).distinct()
    found = checkpoint(_align(pairs, lines, min_chars))

    many = holds.where(F.col("holders") > max(rare, 2))
    open_ = checkpoint(_undeleted(many.where(F.col("d") != F.col("first")).select("d", "h"), lines, found, min_chars))
    if open_.isEmpty():
        return found
    ranks = checkpoint(many.join(open_.select("h").distinct(), "h", "left_semi").select("h", "d", F.row_number().over(by_age).alias("n")))
    own, met, step = ranks.withColumnRenamed("n", "own"), 1, 1
    while True:  # each round meets twice as many holders as the one before
        open_ = open_.join(own, ["h", "d"]).where(F.col("own") > met + 1).select("h", "d", "own")
        nexts = open_.select("h", "d", F.explode(F.sequence(F.lit(met + 1), F.least(F.lit(met + step), F.col("own") - 1))).alias("n"))
        more = checkpoint(nexts.join(ranks.withColumnRenamed("d", "e"), ["h", "n"]).select("d", "e").distinct())
        if more.isEmpty():
            return found
        new = _align(more, lines.join(more.select("d").union(more.select("e")).distinct(), "d", "left_semi"), min_chars)
        found = checkpoint(found.union(new).groupBy("d").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines")))
        open_ = checkpoint(_undeleted(open_, lines, found, min_chars))
        met, step = met + step, 2 * step


def dedup_lines(docs: DataFrame, rare: int = RARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``docs`` with its own columns, the text without its deleted lines, and n_lines and deleted_lines.

    Lines are compared without spaces around them. A block of aligned lines is
    deleted if it has at least ``min_chars`` characters. Earlier is the smaller
    doc_id, nulls first; rows alike in doc_id and text are one document, rows that
    only share the doc_id are different ones. Null texts stay null, with 0 lines;
    blank lines name no partners. An empty table gives no rows. An alignment is one
    to one: of a run that stands several times in a document, one deleted copy is
    enough to ask no further holders, so further copies may stay.
    """
    tag = free_name(docs.columns, "_line")
    doc, key, gone, split = (f"{tag}_{x}" for x in ("doc", "key", "gone", "split"))
    found = common_lines(docs, rare, min_chars).select(F.col("d.doc_id").alias(doc), F.col("d.text").alias(f"{key}_found"), F.col("lines").alias(gone))
    own = docs.withColumn(key, F.xxhash64("text"))
    on = own["doc_id"].cast("long").eqNullSafe(found[doc]) & (own[key] == found[f"{key}_found"])
    joined = own.join(found, on, "left").withColumn(split, F.split("text", "\n"))
    count = F.coalesce(F.size(split), F.lit(0))
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.col(split)[i]), "\n"))
    n = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(count).cast("long"), "deleted_lines": F.coalesce(F.when(F.col(gone).isNotNull(), F.size(gone)), F.lit(0)).cast("long")}
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in n]
    return joined.select(*columns, *(c.alias(k) for k, c in n.items()))
