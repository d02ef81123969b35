"""Mixing sources to target weights by pivotal dependent rounding.

A document is copied target / source size times. The whole part is sure; the
fractions are settled in pairs that pass words to one another until one
document's copies are whole, so the words of a source stay as they are. Shards
of a source and size class settle their own documents; their single open
documents meet again in a reduction tree. The last open document of each size
class is rounded from the largest class down, each error passing to the next
smaller class.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.text import code_point_key, free_name, given_id, held_id, n_words
from voxmill.session import checkpoint

SHARD, FAN_IN = 512, 64
SMALL_TABLE = 10_000
OPEN = "key string, class int, shard long, doc_id long, source string, size long, rows long, whole double, part double"


def join_small(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Broadcast the other side only if its counted rows are few."""
    return df.join(F.broadcast(small) if small.count() <= SMALL_TABLE else small, on)


def source_targets(stats: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(key, words) -> (key, source_size, target). One row a source.

    Targets share all words by weight, none above cap times its source's words.
    With sources ordered by cap * words / weight, the first ones reach their cap
    and the rest share what is left at one rate.
    """
    s = stats.where("words > 0")
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.expr(f"cast((row_number() over (order by key) - 1) % {len(weights)} as int) + 1")).cast("double"))
    s = s.withColumn("limit", F.col("words") * F.lit(float(cap)))
    order = "order by limit / w, key rows between"
    s = s.withColumns({"all": F.expr("sum(words) over ()"), "used": F.expr(f"sum(limit) over ({order} unbounded preceding and current row) - limit"), "left": F.expr(f"sum(w) over ({order} current row and unbounded following)")})
    s = s.withColumn("rate", (F.col("all") - F.col("used")) / F.col("left"))
    # the rate rises as long as a source reaches its limit, and falls from the first that doesn't: the highest is the one that holds
    s = s.withColumn("rate", F.expr("max(rate) over ()"))
    return s.select("key", F.col("words").alias("source_size"), F.least("limit", F.col("rate") * F.col("w")).alias("target"))


def settle(pdf: pd.DataFrame, seed: str) -> pd.DataFrame:
    """Pairwise transfers of words until at most one row's copies stay open."""
    rng = np.random.default_rng(zlib.crc32(seed.encode()))
    pdf = pdf.sort_values(["doc_id", "size", "rows"], kind="stable", na_position="last").reset_index(drop=True)
    pdf = pdf.iloc[rng.permutation(len(pdf))].reset_index(drop=True)
    w = (pdf["size"] * pdf["rows"]).to_numpy(float)
    mass, chance = pdf["part"].to_numpy(float) * w, rng.random(len(pdf))
    i = 0
    for j in range(1, len(pdf)):
        rise, fall = min(w[i] - mass[i], mass[j]), min(mass[i], w[j] - mass[j])
        step = rise if chance[j] * (rise + fall) < fall else -fall
        mass[i] += step
        mass[j] -= step
        if min(mass[i], w[i] - mass[i]) <= 1e-9 * w[i]:
            i = j
    part = mass / w
    pdf["part"] = np.where(np.minimum(part, 1 - part) <= 1e-9, np.round(part), part)
    return pdf


def settler(level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """settle() for one level of the tree, seeded by the level and the group."""
    return lambda group, pdf: settle(pdf, f"{level}/{group[0]}/{int(group[1])}/{int(group[2])}")


def settle_last(pdf: pd.DataFrame, cap: float) -> pd.DataFrame:
    """Round the open rows of one source, the largest first; the error passes on."""
    pdf = pdf.assign(w=pdf["size"] * pdf["rows"]).sort_values(["w", "doc_id"], ascending=[False, True], kind="stable")
    error, parts = 0.0, []
    for whole, part, w in zip(pdf["whole"], pdf["part"], pdf["w"], strict=True):
        copies = min(max(round((part * w + error) / w), -whole), np.floor(cap) - whole)
        error += (part - copies) * w
        parts.append(float(copies))
    return pdf.assign(part=parts).drop(columns="w")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies), a row for each row of ``docs``.

    Reads doc_id, text and source; other columns are ignored. Size is the number of
    words (0 for null and blank texts, which take no words and stay as one copy).
    Null is a source of its own, after all others. Rows alike in doc_id, source and
    size are settled together. Reruns agree, whatever the partitions. An empty
    table gives no rows.
    """
    key = F.coalesce(code_point_key(F.col("source")), F.lit("~"))
    sized = docs.select(held_id(F.col("doc_id")).alias("doc_id"), "source", key.alias("key"), n_words(F.col("text")).alias("size"))
    units = sized.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("rows"))
    units = checkpoint(units.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size") * F.col("rows")))).otherwise(-1).cast("int")))
    stats = checkpoint(units.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("rows")).alias("words")))
    targets = checkpoint(source_targets(stats.groupBy("key").agg(F.sum("words").alias("words")), weights, cap))
    shards = stats.select("key", "class", F.ceil(F.col("n") / SHARD).alias("shards"))
    per_class = shards.join(targets, "key", "left")
    work = join_small(units, per_class, ["key", "class"]).withColumn("share", F.col("target") / F.col("source_size"))
    work = work.withColumns({"whole": F.floor("share").cast("double"), "shard": F.pmod(F.xxhash64("doc_id", "size"), "shards")})
    todo = work.where("size > 0").select("key", "class", "shard", "doc_id", "source", "size", "rows", "whole", (F.col("share") - F.col("whole")).alias("part"))
    most = stats.agg(F.max("n")).first()[0] or 0
    shards_left, level, done = -(-most // SHARD), 0, []
    while True:
        todo = checkpoint(todo.groupBy("key", "class", "shard").applyInPandas(settler(level), OPEN))
        done.append(todo.where("part in (0, 1)"))
        todo = todo.where("part not in (0, 1)")
        if shards_left <= 1:
            break
        shards_left, level = -(-shards_left // FAN_IN), level + 1
        todo = todo.withColumn("shard", F.floor(F.col("shard") / FAN_IN))
    done.append(todo.groupBy("key").applyInPandas(lambda pdf: settle_last(pdf, cap), OPEN))
    settled = done[0]
    for more in done[1:]:
        settled = settled.unionByName(more)
    settled = settled.select("key", "doc_id", "source", "size", "rows", (F.col("whole") + F.col("part")).cast("long").alias("copies"))
    blank = units.where("size = 0").select("key", "doc_id", "source", "size", "rows", F.lit(1).cast("long").alias("copies"))
    out = settled.unionByName(blank).join(F.broadcast(targets) if targets.count() <= SMALL_TABLE else targets, "key", "left")
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return out.select(given_id(F.col("doc_id")).alias("doc_id"), "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them: each as often as its copies, with their own columns."""
    copies = mix(docs, **settings).select("doc_id", "source", "size", "copies").distinct()
    names = [f"`{c}`" for c in docs.columns]
    size = free_name(docs.columns, "_mix")
    own = docs.withColumn(size, n_words(F.col("text")))
    on = own["doc_id"].eqNullSafe(copies["doc_id"]) & own["source"].eqNullSafe(copies["source"]) & (own[size] == copies["size"])
    taken = own.join(copies, on).where(copies["copies"] > 0).select(*(own[c] for c in names), F.sequence(F.lit(1).cast("long"), copies["copies"]).alias(size))
    return taken.withColumn(size, F.explode(size)).drop(size)
