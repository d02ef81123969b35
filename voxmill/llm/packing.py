"""Conflict-constrained best-fit packing of documents into bins of words.

No bin takes two pieces of one source or of one cluster of duplicates. Each
shard packs its pieces, the largest first, into the tightest bin that fits and
whose bitmaps don't conflict.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm.text import given_id, held_id, n_words
from voxmill.session import checkpoint

CAPACITY, SHARD = 2048, 4096
UNNAMED = 1024  # parts in which rows without a doc_id are numbered
OUT = "doc_id long, copy long, piece int, start long, words long, source string, cluster string, bin string"


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """The bin of each piece, in the given order. A negative source or cluster conflicts with none.

    Bins are ordered by what is left in them. The search begins at the tightest bin
    that fits and goes on to its successors until the bitmaps have no bit in common.
    """
    least = min(sizes, default=0)
    bins: list[tuple[int, int]] = []  # (left, bin), ordered
    held: list[list[int]] = []  # source and cluster bitmaps of each bin
    out = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(bins, (size, -1))
        while at < len(bins) and (held[bins[at][1]][0] & s or held[bins[at][1]][1] & c):
            at += 1
        if at < len(bins):
            left, b = bins.pop(at)
            held[b][0] |= s
            held[b][1] |= c
        else:
            left, b = capacity, len(held)
            held.append([s, c])
        out.append(b)
        if left - size >= least:  # else nothing fits any more
            insort(bins, (left - size, b))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, shard_rows: int = SHARD) -> DataFrame:
    """(doc_id, copy, piece, start, words, source, cluster, bin), together all words of every row.

    Reads doc_id, text and source; other columns are ignored. A text of more than
    ``capacity`` words is cut: whole pieces fill a bin each, the rest is packed.
    Null and blank texts are pieces of 0 words and are packed too. ``cluster`` names
    the duplicates, by default texts that are equal; null sources and clusters
    conflict with nothing. Rows with the same doc_id are told apart by ``copy``,
    which counts them; those without a doc_id are numbered in parts, with gaps.
    Pieces are dealt to shards of about ``shard_rows`` by hash, so no source or
    cluster gathers in one task. Reruns agree; an empty table gives no rows.
    """
    cluster = F.md5(F.col("text")) if cluster is None else cluster.cast("string")
    p = docs.select(held_id(F.col("doc_id")).alias("doc_id"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"), n_words(F.col("text")).alias("size"))
    unnamed = given_id(F.col("doc_id")).isNull()
    p = p.withColumn("part", F.when(unnamed, F.pmod(F.xxhash64("size", "source", "cluster"), F.lit(UNNAMED))).otherwise(0))
    number = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy("size", "source", "cluster")).cast("long")
    p = checkpoint(p.withColumn("copy", F.when(unnamed, (number - 1) * UNNAMED + F.col("part") + 1).otherwise(number)).drop("part"))
    full = p.where(F.col("size") >= capacity).withColumn("piece", F.explode(F.sequence(F.lit(0), (F.col("size") / capacity).cast("int") - 1)))
    name = F.concat(F.lit("whole:"), F.coalesce(given_id(F.col("doc_id")).cast("string"), F.lit("null")), F.lit(":"), "copy", F.lit(":"), "piece")
    full = full.select("doc_id", "copy", "piece", (F.col("piece") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("words"), "source", "cluster", name.alias("bin"))
    rest = p.withColumns({"words": F.col("size") % capacity, "piece": (F.col("size") / capacity).cast("int")}).where((F.col("words") > 0) | (F.col("size") == 0))
    shards = -(-p.count() // shard_rows) or 1
    rest = rest.select("doc_id", "copy", "piece", (F.col("size") - F.col("words")).alias("start"), "words", "source", "cluster", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(shards)).alias("shard"))

    def pack_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["words", "doc_id", "copy"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        source = pd.factorize(pdf["source"])[0].tolist()
        shared = pdf["cluster"].where(pdf["cluster"].duplicated(keep=False))
        found = best_fit(pdf["words"].tolist(), source, pd.factorize(shared)[0].tolist(), capacity)
        return pdf.drop(columns="shard").assign(bin=[f"{key[0]}:{b}" for b in found])

    packed = full.unionByName(rest.groupBy("shard").applyInPandas(pack_shard, OUT))
    return packed.withColumn("doc_id", given_id(F.col("doc_id")))
