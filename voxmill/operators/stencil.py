"""Stencils: weighted neighbour sums by scatter, and grids of other resolutions."""

from __future__ import annotations

from itertools import product
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import FACES, KEY, shifted


def smooth(cells: DataFrame, radius: float = 1.5, value: str = "dc0", density: str = "density") -> DataFrame:
    """(i, j, k, dc0, dc1): the density-weighted mean around each cell, and the raw value.

    The weights are symmetric, so each cell scatters to its neighbours: partial sums
    are made before the one shuffle. Only cells count that are in the table.
    """
    n = int(radius)
    offsets = [o for o in product(range(-n, n + 1), repeat=3) if radius > sqrt(sum(x * x for x in o))]
    weights = [radius - sqrt(sum(x * x for x in o)) for o in offsets]
    sent = shifted(cells.select(*KEY, (F.col(value) * F.col(density)).alias("_v")), offsets, weights)
    got = sent.groupBy(*KEY).agg(F.sum(F.col("w") * F.col("_v")).alias("_v"), F.sum("w").alias("_w"))
    return cells.join(got, KEY).select(*KEY, (F.col("_v") / (F.col("_w") * (F.col(density) + 1e-3))).alias("dc0"), F.col(value).alias("dc1"))


def laplacian_norm(cells: DataFrame, value: str = "density") -> DataFrame:
    """One row: the root of the sum of (6 v - sum of the face neighbours)^2 over the cells; missing ones are 0."""
    sent = shifted(cells.select(*KEY, F.col(value).alias("_v")), FACES).groupBy(*KEY).agg(F.sum("_v").alias("_s"))
    d = 6 * F.col(value) - F.coalesce("_s", F.lit(0.0))
    return cells.join(sent, KEY, "left").agg(F.sqrt(F.sum(d * d)).alias("norm"))


def box_mean(cells: DataFrame, size: int, value: str = "density") -> DataFrame:
    """Mean of each box of size^3 cells; missing ones are 0."""
    keys = [F.floor(F.col(c) / size).cast("int").alias(c) for c in KEY]
    return cells.groupBy(*keys).agg((F.sum(value) / F.lit(float(size**3))).alias(value))


def restrict(nodes: DataFrame, value: str = "u") -> DataFrame:
    """Full weighting to every other node: {.5, 1, .5} on each axis."""
    moved = shifted(nodes.select(*KEY, F.col(value).alias("_v")), list(product((-1, 0, 1), repeat=3)), [0.5 ** sum(map(abs, o)) for o in product((-1, 0, 1), repeat=3)])
    even = moved.where("i % 2 = 0 and j % 2 = 0 and k % 2 = 0")
    half = [F.expr(f"cast({c} / 2 as int)").alias(c) for c in KEY]
    return even.groupBy(*half).agg(F.sum(F.col("w") * F.col("_v")).alias(value))


def prolong(coarse: DataFrame, fine: DataFrame, value: str = "u") -> DataFrame:
    """The fine table with the coarse correction added: copied at even nodes, averaged at odd ones."""
    twice = coarse.select(*((F.col(c) * 2).cast("int").alias(c) for c in KEY), F.col(value).alias("_v"))
    offsets = list(product((-1, 0, 1), repeat=3))
    sent = shifted(twice, offsets, [0.5 ** sum(map(abs, o)) for o in offsets]).groupBy(*KEY).agg(F.sum(F.col("w") * F.col("_v")).alias("_c"))
    return fine.join(sent, KEY, "left").withColumn(value, F.col(value) + F.coalesce("_c", F.lit(0.0))).drop("_c")


def boundary_faces(cells: DataFrame, threshold: float, value: str = "density") -> DataFrame:
    """(i, j, k, dx, dy, dz): faces between a cell at or over the threshold and one under it or missing."""
    full = cells.where(F.col(value) >= threshold).select(*KEY)
    faces = full.withColumn("f", F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(o, ("dx", "dy", "dz"), strict=True))) for o in FACES)))).select(*KEY, "f.*")
    other = full.select(*(F.col(c).alias(f"n{c}") for c in KEY))
    faces = faces.withColumns({f"n{c}": (F.col(c) + F.col(d)).cast("int") for c, d in zip(KEY, ("dx", "dy", "dz"), strict=True)})
    return faces.join(other, ["ni", "nj", "nk"], "left_anti").select(*KEY, "dx", "dy", "dz")


def quantized(cells: DataFrame, value: str = "density") -> DataFrame:
    """Values of [0, 1] as 0 or 1 to 255, in the coordinates of the box of all that isn't 0."""
    full = cells.where(F.col(value) > 0)
    low = full.agg(*(F.min(c).alias(f"{c}0") for c in KEY))  # a single row
    q = F.floor(F.col(value) * 254) + 1
    return full.join(F.broadcast(low)).select(*((F.col(c) - F.col(f"{c}0")).cast("int").alias(c) for c in KEY), q.cast("short").alias("q"))


def channel(cells: DataFrame, value: str) -> DataFrame:
    """(i, j, k, value) over the largest; of magnitudes, if any value is negative. All 0 stays 0."""
    most = cells.agg(F.min(value).alias("_least"), F.max(F.abs(value)).alias("_most"))  # a single row
    v = F.when(F.col("_least") < 0, F.abs(value)).otherwise(F.col(value))
    return cells.join(F.broadcast(most)).select(*KEY, F.when(F.col("_most") > 0, v / F.col("_most")).otherwise(0.0).alias("value"))


def sliced_faces(cells: DataFrame, threshold: float, y: int, value: str = "density") -> DataFrame:
    """boundary_faces of what lies at or over the slice y."""
    return boundary_faces(cells.where(F.col("j") >= y), threshold, value)


def mirrored(cells: DataFrame, axis: str, centre: int) -> DataFrame:
    """The cells and their reflection across a plane."""
    c = KEY["xyz".index(axis)]
    return cells.unionByName(cells.withColumn(c, (F.lit(2 * centre - 1) - F.col(c)).cast("int"))).distinct()


def projection(cells: DataFrame, axes: tuple[str, str] = ("i", "j"), value: str = "density") -> DataFrame:
    """Largest and summed value along the third axis."""
    return cells.groupBy(*axes).agg(F.max(value).alias("most"), F.sum(value).alias("total"))
