"""Textures: values of a stored grid at any point, as one scatter of the grid and one join of the points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import CORNERS, KEY, shifted

Box = tuple[int, int, int]


def cubes(stored: DataFrame, value: str = "density") -> DataFrame:
    """(i, j, k, corners): the eight values of every cube of neighbouring grid points that has one; missing ones are 0.

    A grid point goes to the eight cubes it is a corner of, summed before the one exchange.
    """
    low = [tuple(-x for x in c) for c in CORNERS]
    sent = shifted(stored.select(*KEY, F.col(value).cast("double").alias("value")), low, list(range(8)))
    return sent.groupBy(*KEY).agg(F.array(*(F.coalesce(F.sum(F.when(F.col("w") == n, F.col("value"))), F.lit(0.0)) for n in range(8))).alias("corners"))


def sample(points: DataFrame, stored: DataFrame, res: Box, at: tuple[Column, Column, Column], value: str = "density", name: str = "sampled") -> DataFrame:
    """The points with the trilinear value of the grid of ``res`` points at their position ``at``, each part of it from 0 to 1.

    Grid point n of an axis stands in the middle of the n-th of its equal parts; beyond
    the outer ones the value stays as it is there. Grid points that are not stored count as 0.
    A null position gives a null.
    """
    place = [F.least(F.greatest(p * n - 0.5, F.lit(0.0)), F.lit(float(n - 1))) for p, n in zip(at, res, strict=True)]
    own = points.withColumns({f"_p{c}": p for c, p in zip(KEY, place, strict=True)})
    own = own.withColumns({f"_{c}": F.floor(f"_p{c}").cast("int") for c in KEY})
    part = [F.col(f"_p{c}") - F.col(f"_{c}") for c in KEY]
    grid = cubes(stored, value).select(*(F.col(c).alias(f"_{c}") for c in KEY), "corners")
    met = own.join(grid, [f"_{c}" for c in KEY], "left")
    total = F.lit(0.0)
    for n, corner in enumerate(CORNERS):
        weight = F.lit(1.0)
        for x, t in zip(corner, part, strict=True):
            weight = weight * (t if x else 1 - t)
        total = total + weight * F.col("corners")[n]
    known = part[0].isNotNull() & part[1].isNotNull() & part[2].isNotNull()
    return met.withColumn(name, F.when(known, F.coalesce(total, F.lit(0.0)))).drop("corners", *(f"_p{c}" for c in KEY), *(f"_{c}" for c in KEY))


def inside(sampled: str = "sampled", level: float = 0.5, edge: float = 1e-6) -> Column:
    """Whether a texture's domain holds a point: its value reaches the level."""
    return level - F.col(sampled) <= edge
