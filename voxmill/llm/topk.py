"""Exact top-k by integer inner product with multi-resolution segment statistics.

For a segment of m components with means a, b and standard deviations s, t, the
inner product is m*a*b plus a remainder of at most m*s*t. The bounds of all
segments, with few and then many segments, rule out most candidates before any
exact product is computed. Queries meet all rows in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.vectors import stack, taking_part
from voxmill.session import checkpoint

LEVELS = (1, 4, 16)
CANDIDATES, QUERIES = 1024, 2048
SCHEMA = "query_id long, vec_id long, score long"


def _statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row, sqrt(m) times mean and deviation of every segment, side by side."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    mean = np.stack([p.mean(axis=1) for p in parts], 1)
    dev = np.stack([p.std(axis=1) for p in parts], 1)
    return np.hstack([mean, dev]) * np.sqrt([[p.shape[1] for p in parts] * 2])


def search_block(
    q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, levels: tuple[int, ...] = LEVELS
) -> Iterator[pd.DataFrame]:
    """The k best candidates of the block for every query, but none that scores under the query's floor."""
    big = max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) * q.shape[1]
    exact = np.float64 if big < 2**53 else np.int64 if big < 2**63 else object
    qe, ce = q.astype(exact), c.astype(exact)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    fine = [(_statistics(qf, s), _statistics(cf, s)) for s in levels]
    slack = 1e-9 * big * q.shape[1] + 1e-6
    order = np.argsort(-(fine[-1][1] ** 2).sum(axis=1), kind="stable")
    seed = order[: min(len(order), 8 * k)]
    for i in range(len(q)):
        first = (ce[seed] @ qe[i])[c_ids[seed] != q_ids[i]]
        least = max(floor[i], np.partition(first, len(first) - k)[len(first) - k]) if len(first) >= k else floor[i]
        left = np.flatnonzero(c_ids != q_ids[i])
        for a, b in fine:  # coarse to fine
            left = left[b[left] @ a[i] + slack >= float(least)]
        score = ce[left] @ qe[i]
        at = np.lexsort((c_ids[left], -score))[:k]
        at = at[score[at] >= least]
        yield pd.DataFrame({"query_id": q_ids[i], "vec_id": c_ids[left][at], "score": score[at].astype(np.int64)})


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The k highest integer inner products of each query; columns query_id, rank, vec_id, score.

    Components become floor(scale * x), in double. Queries are the rows whose
    vec_id is divisible by ``every``, candidates all rows but those of the query's
    vec_id, of the same dimension. Null, empty and non-finite vectors and null ids
    take no part; equal rows count once; ties go to the smaller vec_id; an empty
    table gives no rows. Other columns are ignored. Scores must fit a long.
    """
    v = taking_part(vectors).select("vec_id", F.transform("e", lambda x: F.floor(x.cast("double") * scale)).alias("e"))
    v = checkpoint(v.distinct().withColumn("dim", F.size("e")))
    n, n_q = v.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, q_blocks = -(-n // CANDIDATES) or 1, -(-n_q // QUERIES) or 1
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    queries = v.where(F.col("vec_id") % every == 0).withColumn("qb", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(q_blocks)).cast("int"))
    rows = v.withColumn("cb", block).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = search_block(stack(left.e, np.int64), left.vec_id.to_numpy(), left.least.to_numpy(), stack(right.e, np.int64), right.vec_id.to_numpy(), k, levels)
        return pd.concat(list(found), ignore_index=True)

    def against(q: DataFrame, c: DataFrame) -> DataFrame:
        q = q.toDF(*q.columns)
        return q.groupBy("dim", "qb", "cb").cogroup(c.groupBy("dim", "qb", "cb")).applyInPandas(search, SCHEMA)

    lowest = F.lit(-(2**62))
    # the first block gives each query a score that its k-th best can't be under
    first = against(queries.withColumn("cb", F.lit(0)).withColumn("least", lowest), rows.where("cb = 0"))
    floors = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    queries = (
        queries.join(floors.select(F.col("query_id").alias("vec_id"), "least"), "vec_id", "left")
        .withColumn("least", F.coalesce("least", lowest))
        .withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )
    found = against(queries, rows)
    ranked = found.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM r WHERE n <= 5
"""
