"""Approximate nearest neighbours by shifted Hilbert orderings.

Vectors are projected on their main directions; every ordering rotates and
shifts them anew and sorts them along a Hilbert curve. A query looks at a window
of each ordering around its own place; what all orderings find is merged and
scored on the original vectors. How wide the windows have to be depends on the
vectors, so it is measured: some queries' true neighbours are looked up in the
orderings, and as many orderings with such windows are taken as reach the recall
with the fewest inner products.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.vectors import stack, taking_part
from voxmill.session import checkpoint

ORDERINGS, DIMS, BITS = 8, 9, 6
LEAST, BLOCK, REACH, CHUNK = 128, 4096, 4, 16  # rows of a block at least and at most; blocks of a wide window to either side; blocks whose queries go together
SAMPLE, PROBES = 20_000, 64  # vectors that the projection is fitted on; queries that the windows are measured with
RECALL = 0.95
SCHEMA = "query_rep long, rep long, score double"


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with integer coordinates under 2**bits.

    The coordinates' axes are transposed to the curve's Gray code from the highest
    bit down; the key interleaves the result. dims * bits is at most 62.
    """
    axes = list(x.astype(np.int64).T.copy())
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i, a in enumerate(axes):
            set_ = (a >> b) & 1 == 1
            swap = np.where(set_, 0, (axes[0] ^ a) & low)
            axes[0] ^= np.where(set_, low, swap)
            axes[i] ^= swap
    for i in range(1, len(axes)):
        axes[i] ^= axes[i - 1]
    turn = np.zeros_like(axes[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(axes[0])
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = (key << 1) | (((a ^ turn) >> b) & 1)
    return key


def fit_projection(sample: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, main directions and extent of a bounded sample."""
    mean = sample.mean(axis=0)
    _, axes = np.linalg.eigh((sample - mean).T @ (sample - mean))
    axes = axes[:, ::-1][:, :dims]
    return mean, axes, float(np.abs((sample - mean) @ axes).max(initial=0)) or 1.0


def ordering_keys(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, extent: float, ordering: int, bits: int) -> np.ndarray:
    """Keys of one rotated and shifted ordering; what lies outside the sample's extent is clipped."""
    rng = np.random.default_rng(ordering)
    turn, _ = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))
    y = (x - mean) @ axes @ turn / (4 * extent) + 0.25 + 0.5 * rng.random(axes.shape[1])
    return hilbert_keys(np.clip(y * 2**bits, 0, 2**bits - 1), bits)


def nearest(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k largest inner products of each query; sums don't depend on the block's shape."""
    out = []
    for lo in range(0, len(q), 256):
        rough = q[lo : lo + 256] @ c.T
        for i, row in enumerate(rough, lo):
            at = np.arange(len(c))
            if len(c) > k:
                cut = np.partition(row, len(c) - k)[len(c) - k]
                at = np.flatnonzero(row >= cut - 1e-9 * (abs(cut) + np.abs(q[i]).max() * np.abs(c).max()))
            score = (c[at] * q[i]).sum(axis=1)
            best = np.lexsort((c_ids[at], -score))[:k]
            out.append((np.full(len(best), q_ids[i]), c_ids[at][best], score[best]))
    a, b, s = zip(*out, strict=True)
    return pd.DataFrame({"query_rep": np.concatenate(a), "rep": np.concatenate(b), "score": np.concatenate(s)})


def projection(reps: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, float]:
    """fit_projection of at most SAMPLE vectors, chosen by hash, in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [x for pdf in batches for x in pdf.e]
        yield pd.DataFrame({"fit": [pickle.dumps(fit_projection(stack(pd.Series(rows)), dims))]})

    sample = reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("e").repartition(1)
    return pickle.loads(sample.mapInPandas(run, "fit binary").first()[0])


def ranked_orderings(reps: DataFrame, n: int, dims: int, orderings: int, bits: int) -> DataFrame:
    """(ordering, vec_id, place): each vector's place in each ordering, from one range-partitioned sort."""
    spark = reps.sparkSession
    mean, axes, extent = projection(reps, min(dims, 62 // bits))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = stack(pdf.e)
                for m in range(orderings):
                    yield pd.DataFrame({"ordering": np.int32(m), "key": ordering_keys(x, mean, axes, extent, m, bits), "vec_id": pdf.vec_id})

    keyed = reps.mapInPandas(keys, "ordering int, key long, vec_id long")
    sorted_ = keyed.repartitionByRange("ordering", "key", "vec_id").sortWithinPartitions("ordering", "key", "vec_id")
    placed = checkpoint(sorted_.select("ordering", "vec_id", F.monotonically_increasing_id().alias("at")))
    part, mask = F.shiftright("at", 33), F.lit((1 << 33) - 1)
    counts = dict(placed.groupBy(part.alias("p")).count().collect())  # a row for each partition
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    offsets = spark.createDataFrame(offsets, "p long, before long")
    return placed.withColumn("p", part).join(F.broadcast(offsets), "p").select("ordering", "vec_id", (F.col("before") + F.col("at").bitwiseAND(mask) - F.col("ordering") * F.lit(n)).alias("place"))


def true_neighbours(reps: DataFrame, probes: DataFrame, k: int) -> list[tuple[int, int]]:
    """(query, neighbour): the k nearest of at most PROBES queries, by brute force over all rows."""
    q = probes.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).toPandas()
    if not len(q):
        return []
    x, ids = stack(q.e), q.vec_id.to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"query_rep": [], "rep": [], "score": []})
        for pdf in batches:
            if len(pdf):
                found = nearest(x, ids, stack(pdf.e), pdf.vec_id.to_numpy(), k + 1)
                best = pd.concat([best, found]).sort_values(["score", "rep"], ascending=[False, True]).groupby("query_rep").head(k + 1)
        yield best.astype({"query_rep": "int64", "rep": "int64", "score": "float64"})

    found = reps.select("vec_id", "e").mapInPandas(run, SCHEMA).where("query_rep <> rep")
    found = found.withColumn("n", F.expr("row_number() over (partition by query_rep order by score desc, rep)")).where(F.col("n") <= k)
    return [(r.query_rep, r.rep) for r in found.select("query_rep", "rep").collect()]  # PROBES * k rows


def measured_windows(where: DataFrame, pairs: list[tuple[int, int]], n: int, orderings: int, recall: float) -> tuple[int, int]:
    """(orderings, places to either side) that reach the recall on the given pairs with the fewest inner products."""
    if not pairs:
        return 1, n
    spark = where.sparkSession
    asked = F.broadcast(spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p})], "vec_id long"))
    place = {(r.ordering, r.vec_id): r.place for r in where.join(asked, "vec_id").collect()}
    q, c = (np.array([[place[m, p[i]] for p in pairs] for m in range(orderings)]) for i in (0, 1))
    far = np.minimum.accumulate(np.abs(q - c), axis=0)  # by the orderings so far
    reach = np.sort(far, axis=1)[:, min(len(pairs) - 1, int(np.ceil(recall * len(pairs))))]
    cost = [(m + 1) * min(n, 2 * int(w) + 1) for m, w in enumerate(reach)]
    best = int(np.argmin(cost))
    return best + 1, int(reach[best])


def search(vectors: DataFrame, k: int = 20, every: int = 20, orderings: int = ORDERINGS, dims: int = DIMS, bits: int = BITS, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """The k nearest found of each query by inner product; columns query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows
    but those of the query's vec_id, of the same dimension. Equal vectors are
    searched once: a class of copies stands for its k + 1 smallest ids, which is
    all that a result can hold. Null, zero, empty and non-finite vectors and null
    ids take no part; equal rows count once; ties go to the smaller vec_id; an
    empty table gives no rows. Other columns are ignored. The projection is fitted
    on at most SAMPLE vectors, and the windows are measured with at most PROBES
    queries against all rows; every vector is indexed. Vectors without structure get
    windows of nearly all rows: then no ordering saves much, but none costs more
    than brute force.
    """
    v = taking_part(vectors).where(F.exists(F.col("e"), lambda x: x != 0)).withColumn("dim", F.size("e"))
    v = v.select("vec_id", "dim", F.transform("e", lambda x: x + F.lit(0.0)).alias("e"))
    v = v.withColumns({"k1": F.xxhash64("e"), "k2": F.xxhash64(F.lit(7), F.reverse("e"), F.size("e"))})
    numbered = v.withColumn("n", F.expr("row_number() over (partition by k1, k2 order by vec_id)"))
    members = checkpoint(numbered.where(F.col("n") <= k + 1))
    classes = members.where("n = 1")
    ids = members.select("k1", "k2", "vec_id")
    queries = v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "k1", "k2")
    asked = queries.select("k1", "k2").distinct()
    found = None
    for dim, n in classes.groupBy("dim").count().collect():  # a row for each dimension
        reps = classes.where(F.col("dim") == dim)
        own = reps.join(asked, ["k1", "k2"], "left_semi").select("vec_id", "e")
        where = ranked_orderings(reps.select("vec_id", "e"), n, dims, orderings, bits)
        used, wide = measured_windows(where, true_neighbours(reps, own, k), n, orderings, recall)
        size = min(block, max(LEAST, -(-wide // REACH)))
        reach, last = -(-wide // size), (n - 1) // size
        at = where.where(F.col("ordering") < used).withColumn("block", (F.col("place") / size).cast("long"))
        # a block meets the queries of CHUNK blocks at a time
        chunks = F.sequence((F.greatest(F.col("block") - reach, F.lit(0)) / CHUNK).cast("long"), (F.least(F.col("block") + reach, F.lit(last)) / CHUNK).cast("long"))
        rows = at.join(reps.select("vec_id", "e"), "vec_id").withColumn("chunk", F.explode(chunks))
        near = F.explode(F.sequence(F.greatest(F.col("block") - reach, F.lit(0)), F.least(F.col("block") + reach, F.lit(last))))
        q = at.join(own, "vec_id").withColumn("chunk", (F.col("block") / CHUNK).cast("long")).withColumn("block", near)
        q = q.toDF(*q.columns)

        def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_rep": [], "rep": [], "score": []})
            return nearest(stack(left.e), left.vec_id.to_numpy(), stack(right.e), right.vec_id.to_numpy(), k + 1)

        key = ("ordering", "block", "chunk")
        seen = q.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(look, SCHEMA)
        found = seen if found is None else found.unionByName(seen)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], SCHEMA)
    merged = found.groupBy("query_rep", "rep").agg(F.max("score").alias("score"))
    merged = merged.withColumn("n", F.expr("row_number() over (partition by query_rep order by score desc, rep)")).where(F.col("n") <= k + 1)
    rep_keys = classes.select(F.col("vec_id").alias("rep"), "k1", "k2")
    rows = merged.join(rep_keys, "rep").join(ids, ["k1", "k2"]).select("query_rep", "vec_id", "score")
    rows = rows.withColumn("n", F.expr("row_number() over (partition by query_rep order by score desc, vec_id)")).where(F.col("n") <= k + 1)
    answers = rows.join(rep_keys.select(F.col("rep").alias("query_rep"), "k1", "k2"), "query_rep").select("k1", "k2", "vec_id", "score")
    out = queries.distinct().join(answers, ["k1", "k2"]).where("vec_id <> query_id")
    out = out.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)"))
    return out.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
