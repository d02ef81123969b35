"""Periodic runs of words, found over a run-length grammar that recompression builds.

Texts are concatenated, each fenced by symbols that occur once. Rounds of block
compression (a maximal run of one symbol becomes a symbol) and pair compression
(symbols are left or right ones by a bit of their hash; a left one before a right
one becomes a symbol) make a grammar whose symbols are named by hashes of what
they stand for, so equal stretches have equal symbols but at their edges. Longest
common extensions of two places climb and descend that grammar. A run of period q
and three periods at least holds two steps of the grid 0, q, 2q, ...; such places
of all grids are extended to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm.text import WORD, mix, n_words, ranges, slices, span_hashes, spans

LEAST, TIMES = 24, 3  # a run's least length in words and in periods
ROUNDS = 200  # of compression, which takes about a quarter of the symbols each; fewer levels make extensions slower, not wrong
BATCH = 1 << 20  # candidates that are extended at a time
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


class Grammar(NamedTuple):
    """The symbols of all levels one after another; the texts' own come first.

    ``up`` names the symbol that one is part of, ``first`` and ``last`` its own
    first and last part (-1 for words), ``ahead`` and ``behind`` how many equal
    parts of its block stand from it on and up to it.
    """

    symbol: np.ndarray
    up: np.ndarray
    first: np.ndarray
    last: np.ndarray
    ahead: np.ndarray
    behind: np.ndarray


def blocks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, places of their first parts) after block compression."""
    head = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=head[1:])
    first = np.flatnonzero(head)
    size = np.diff(first, append=len(x)).astype(np.uint64)
    out = x[first]
    many = size > 1
    out[many] = mix(out[many] * _ODD + size[many])
    return out, first


def pairs(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, places of their first parts) after pair compression."""
    right = mix(x + np.uint64((2 * level + 1) * int(_ODD) % 2**64)) >> np.uint64(63) == 1
    second = np.zeros(len(x), bool)
    second[1:] = right[1:] & ~right[:-1]
    first = np.flatnonzero(~second)
    out = x[first]
    pair = np.flatnonzero(second[1:])  # a pair's first part
    out[np.searchsorted(first, pair)] = mix(mix(x[pair]) * _ODD + x[pair + 1])
    return out, first


def recompress(x: np.ndarray, texts: int = 1) -> Grammar:
    """The grammar of fenced texts, up to a level of about two symbols a text."""
    levels, steps = [x], []
    for level in range(ROUNDS):
        if len(levels[-1]) <= 2 * texts + 2:
            break
        for is_block in (True, False):
            y, first = blocks(levels[-1]) if is_block else pairs(levels[-1], level)
            if len(y) < len(levels[-1]):
                levels.append(y)
                steps.append((first, is_block))
    at = np.cumsum([0, *map(len, levels)])
    n = int(at[-1])
    up, first, last = np.arange(n), np.full(n, -1), np.full(n, -1)
    ahead, behind = np.ones(n, np.int64), np.ones(n, np.int64)
    for h, (begin, is_block) in enumerate(steps):
        below, own = slice(at[h], at[h + 1]), slice(at[h + 1], at[h + 2])
        size = np.diff(begin, append=len(levels[h]))
        first[own], last[own] = begin + at[h], begin + size - 1 + at[h]
        up[below] = np.repeat(np.arange(at[h + 1], at[h + 2]), size)
        if is_block:
            place = np.arange(len(levels[h])) - np.repeat(begin, size)
            behind[below], ahead[below] = place + 1, np.repeat(size, size) - place
    return Grammar(np.concatenate(levels), up, first, last, ahead, behind)


def extension(g: Grammar, a: np.ndarray, b: np.ndarray, forward: bool = True) -> np.ndarray:
    """How many words from places a and b on are the same (or up to a and b, backwards).

    All queries go on together: from equal symbols that begin equal symbols one
    level up, else over equal symbols (a block's equal parts at once), and from
    unlike symbols one level down, until two words differ. Fences differ always.
    """
    end, rest, sign = (g.first, g.ahead, 1) if forward else (g.last, g.behind, -1)
    x, y, live, out = a, b, np.arange(len(a)), np.zeros(len(a), np.int64)
    while len(live):
        same = g.symbol[x] == g.symbol[y]
        px, py, cx, cy = g.up[x], g.up[y], end[x], end[y]
        over = same & (end[px] == x) & (end[py] == y) & (g.symbol[px] == g.symbol[py])
        step = sign * np.minimum(rest[x], rest[y])
        done = ~same & (cx < 0)
        out[live[done]] = np.abs(x[done] - a[live[done]])
        x = np.where(over, px, np.where(same, x + step, cx))[~done]
        y = np.where(over, py, np.where(same, y + step, cy))[~done]
        live = live[~done]
    return out


def grid_places(x: np.ndarray, text: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places i, periods q) where the words at i, i + q and i + 2q are the same, i a multiple of q; in batches.

    The texts stand longest first, so those that are long enough for a period are the first ones.
    """
    found, held = [], 0
    for q in range(1, (int(sizes[0]) // TIMES if len(sizes) else 0) + 1):
        enough = int(np.searchsorted(-sizes, -max(TIMES * q, LEAST), side="right"))
        g = x[: ends[enough - 1] : q]
        same = g[1:] == g[:-1]
        i = np.flatnonzero(same[1:] & same[:-1]) * q
        i = i[text[i] == text[i + 2 * q]]
        for lo in range(0, len(i), BATCH):
            part = i[lo : lo + BATCH]
            found.append((part, np.full(len(part), q)))
            held += len(part)
            if held >= BATCH:
                yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
                found, held = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


def runs(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    Text t has the words ``rows[t]`` to ``rows[t + 1]``. A run has its smallest
    period q, max(LEAST, TIMES * q) words at least, and can't be extended.
    """
    count = np.diff(rows)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] >= LEAST]
    sizes, none = count[order], np.zeros((0, 4), np.int64)
    if not len(order):
        return none
    begins = np.cumsum(np.concatenate([[1], sizes[:-1] + 1]))  # behind a fence each
    x = mix(np.arange(begins[-1] + sizes[-1] + 1, dtype=np.uint64) * _ODD + np.uint64(1))
    x[ranges(begins, sizes)] = words[ranges(rows[order], sizes)]
    text = np.repeat(np.arange(len(order) + 1), np.concatenate([[1], sizes + 1]))
    grammar, found = None, none
    for i, q in grid_places(x, text, begins + sizes, sizes):
        grammar = recompress(x, len(order)) if grammar is None else grammar
        back = extension(grammar, i - 1, i + q - 1, forward=False)
        length = back + extension(grammar, i, i + q) + q
        good = length >= np.maximum(LEAST, TIMES * q)
        i, q, back, length = i[good], q[good], back[good], length[good]
        start = i - back
        found = np.concatenate([found, np.stack([text[i] - 1, start, length, q], axis=1)])
        # a multiple of a run's period finds the same run
        found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1]))]
        found = found[np.concatenate([[True], (np.diff(found[:, 1:3], axis=0) != 0).any(axis=1)])] if len(found) else found
    found[:, 1] -= begins[found[:, 0]]
    found[:, 0] = order[found[:, 0]]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs``; each row by itself, ids may repeat or be null.

    ``runs`` holds (start, length, period) in words from 0 on, by start and period;
    words are the same if their bytes are. ``collapsed`` is the text's words with
    single spaces, without those that stand behind the first period of a run that
    holds them. A null or blank text has no words and no runs; other columns are
    ignored, an empty table gives no rows. A text is searched as a whole in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for first, data, at in slices(batch.column(1), lower=False):
                begin, end, rows = spans(data, at)
                r = runs(span_hashes(data, begin, end), rows)
                cut = np.searchsorted(r[:, 0], np.arange(len(rows)))
                raw, collapsed = data.tobytes(), []
                for t in range(len(at) - 1):
                    words = raw[at[t] : at[t + 1]].split()
                    if cut[t] < cut[t + 1]:
                        drop = np.zeros(len(words) + 1, np.int64)
                        for _, start, length, q in r[cut[t] : cut[t + 1]]:
                            drop[start + q] += 1
                            drop[start + length] -= 1
                        words = [words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
                    collapsed.append(b" ".join(words))
                listed = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(r[:, c]) for c in (1, 2, 3)], fields=list(kind.value_type)))
                texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(at) - 1), pa.array(np.diff(rows)), listed, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    out = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by crc32 of their ids, repeat a part of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    d = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), n_words(F.col("text")).alias("n"))
    a = F.col("g") % F.greatest("n", F.lit(1))
    p = 1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))
    d = d.withColumns({"a": a, "p": p, "planted": F.coalesce((F.col("h") % 10 == 0) & (F.col("n") > 0), F.lit(False))})

    # whole arrays instead of a function of each place, into which Spark would copy the search for words
    w, a, p = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.col("a").cast("int"), F.col("p").cast("int")
    left = (F.col("n") - F.col("a")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(left / p).cast("int"))), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")
    return d.where("not planted").select("doc_id", "text").union(d.where("planted").select("doc_id", planted.alias("text")))


def digests(found: DataFrame) -> DataFrame:
    """What the query returns of ``periodic_runs``: the run of most periods, and digests of runs and texts."""

    def order(a: Column, b: Column) -> Column:
        more, less = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(more > less, -1).when(more < less, 1).when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise(F.signum(a["period"] - b["period"]).cast("int"))

    best = F.get(F.array_sort("runs", order), F.lit(0))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    f = found.withColumn("best", best)
    return f.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col("best")[c].alias(c) for c in ("start", "length", "period")), F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
