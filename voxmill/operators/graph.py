"""Connected components: edges are contracted within partitions, then between them by joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.session import checkpoint

EDGES_A_TASK = 200_000


def is_star_forest(e: DataFrame) -> bool:
    """Each u of the edges (u, v), v < u, has one v, which is no u itself: v is its component's least node."""
    ends = e.select(F.col("u").alias("x"), "v", F.lit(0).alias("down")).union(e.select("v", F.lit(None), F.lit(1)))
    bad = ends.groupBy("x").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("down").alias("down")).where("least <> most or (least is not null and down > 0)")
    return bad.isEmpty()


def contracted(e: DataFrame) -> DataFrame:
    """Each partition's edges as stars: (u, v) from every node to the least one that the partition's edges join it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(up.setdefault(a, a)), top(up.setdefault(b, b))
                if a != b:
                    up[max(a, b)] = min(a, b)
        stars = [(x, top(x)) for x in list(up)]
        stars = [s for s in stars if s[0] != s[1]]
        for lo in range(0, len(stars), 1 << 15):
            part = list(zip(*stars[lo : lo + (1 << 15)], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, schema, strict=True)], schema=schema)

    return e.select("u", "v").mapInArrow(run, e.select("u", "v").schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Partitions of at most about EDGES_A_TASK edges are contracted to stars by
    themselves. Until the stars of all partitions fit together, two star steps join
    them, so the number of rounds follows the logarithm of what is left of the
    diameter. Each round's pairs are pre-aggregated before they are shuffled, and a
    hub's pairs are split by Spark's skew join. Null ends and self loops are ignored;
    an empty edge table gives an empty result.
    """
    e = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = checkpoint(e)
    tasks = -(-e.count() // EDGES_A_TASK) or 1
    for _ in range(max_rounds):
        e = checkpoint(contracted(e.coalesce(tasks)))
        if is_star_forest(e):
            break
        # large star: every neighbour above a node goes to the node's smallest neighbour
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and the neighbours below it go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(hung.union(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components aren't final after {max_rounds} rounds")
    # a node and its component, each once
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
