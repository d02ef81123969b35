"""Scans of integer boxes and the cells that a domain populates."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.functions.grid import CORNERS, FIXED_DENSITY, INSIDE, KEY, PADDING, equal_keys, shifted, to_position, with_block
from voxmill.functions.sdf import EDGE, Sdf

Box = tuple[int, int, int]


def region(spark: SparkSession, low: Box, high: Box) -> DataFrame:
    """All integer points of the half-open box."""
    n = [max(0, b - a) for a, b in zip(low, high, strict=True)]
    at = spark.range(n[0] * n[1] * n[2])
    n = [max(1, x) for x in n]
    i, j, k = F.expr(f"id div {n[1] * n[2]}"), F.expr(f"id div {n[2]} % {n[1]}"), F.col("id") % n[2]
    return at.select(*((c + F.lit(a)).cast("int").alias(name) for c, a, name in zip((i, j, k), low, KEY, strict=True)))


def refined(blocks: DataFrame, low: Box, high: Box, sdf: Sdf, dx: float, side: int) -> DataFrame:
    """Of the blocks (by their least cell) of cells ``side`` long those that can hold a cell of the domain.

    The domain's value at a block's centre, less what it can change on the way to a cell's centre, bounds all its cells.
    """
    value = sdf(*(to_position(F.col(c) + side / 2, dx) for c in KEY))
    margin = sdf.steep * 3**0.5 * (side - 1) / 2 * dx
    met = [(F.col(c) < b) & (F.col(c) + side > a) for c, a, b in zip(KEY, low, high, strict=True)]
    return blocks.where(met[0] & met[1] & met[2] & (value - margin <= 2 * EDGE))


def candidates(spark: SparkSession, low: Box, high: Box, sdf: Sdf, dx: float, sides: tuple[int, ...] = (64, 16, 4)) -> DataFrame:
    """The cells of the box in blocks that can hold a cell of the domain, from coarse blocks to fine ones; one stage without a shuffle."""
    first = sides[0]
    blocks = region(spark, tuple(a // first for a in low), tuple(-(-b // first) for b in high))
    blocks = blocks.select(*((F.col(c) * first).cast("int").alias(c) for c in KEY))
    for side, step in zip(sides, (*sides[1:], 1), strict=True):
        blocks = refined(blocks, low, high, sdf, dx, side)
        for c in KEY:
            blocks = blocks.withColumn(c, F.explode(F.sequence(F.col(c), F.col(c) + (side - step), F.lit(step))))
    inside = [F.col(c).between(a, b - 1) for c, a, b in zip(KEY, low, high, strict=True)]
    return blocks.where(inside[0] & inside[1] & inside[2])


def populate(
    spark: SparkSession, res: Box, sdf: Sdf, bounding_box: tuple[tuple[float, ...], tuple[float, ...]] | None = None, mirror: str = "", density: float | Column = 0.1
) -> DataFrame:
    """Cells (i, j, k, flags, density, mirror_axes) whose centre lies in the domain.

    A mirrored axis keeps the cells up to the centre and gains one further cell as
    symmetry plane, whose ``mirror_axes`` names the axes to fix there.
    """
    dx = 1.0 / res[0]
    low, high = (PADDING,) * 3, tuple(PADDING + r for r in res)
    if bounding_box:
        low = tuple(max(a, int((p + 0.5) / dx) + PADDING) for a, p in zip(low, bounding_box[0], strict=True))
        high = tuple(min(a, int((p + 0.5) / dx) + PADDING) for a, p in zip(high, bounding_box[1], strict=True))
    # a distance function is asked block by block first, any other one at every cell
    cells = candidates(spark, low, high, sdf, dx) if getattr(sdf, "steep", None) else region(spark, low, high)
    cells = cells.where(sdf(*(to_position(F.col(c) + 0.5, dx) for c in KEY)) <= EDGE).withColumn("mirror_axes", F.lit(""))
    for axis in mirror:
        cells = mirror_clip(cells, axis, res["xyz".index(axis)] // 2 + PADDING)
    return cells.select(*KEY, F.lit(INSIDE).cast("long").alias("flags"), (density if isinstance(density, Column) else F.lit(float(density))).alias("density"), "mirror_axes")


def mirror_clip(cells: DataFrame, axis: str, centre: int) -> DataFrame:
    """The half up to the centre and its symmetry plane; ``mirror_axes`` gains the axis there."""
    c = KEY["xyz".index(axis)]
    cells = cells.where(F.col(c) <= centre)
    plane = cells.where(F.col(c) == centre).withColumns({c: (F.col(c) + 1).cast("int"), "mirror_axes": F.concat("mirror_axes", F.lit(axis))})
    return cells.unionByName(plane)


def wireframe_density(grid: int = 32, thickness: int = 4, low: float = 0.0) -> Column:
    """1 on a lattice of blocks that lie within ``thickness`` on two axes at least, else the least density."""
    near = sum(((F.floor(F.col(c) / 4) % grid < thickness).cast("int") for c in KEY), F.lit(0))
    return F.when(near >= 2, 1.0).otherwise(float(low))


def bounds(cells: DataFrame) -> DataFrame:
    """One row: least coordinates, largest plus one, and the number of cells."""
    return cells.agg(*(F.min(c).alias(f"{c}_min") for c in KEY), *((F.max(c) + 1).alias(f"{c}_max") for c in KEY), F.count("*").alias("cells"))


def counters(cells: DataFrame) -> DataFrame:
    """One row: cells, hard cells (fixed density) and the sum of densities."""
    return cells.agg(F.count("*").alias("cells"), F.count_if(F.col("flags").bitwiseAND(F.lit(FIXED_DENSITY)) != 0).alias("hard"), F.sum("density").alias("volume"))


def node_blocks(cells: DataFrame, size: Box = (4, 4, 4)) -> DataFrame:
    """The blocks of all corner nodes of the cells."""
    return with_block(shifted(cells.select(*KEY), CORNERS), size).select("bi", "bj", "bk").distinct()


def nodes_of(cells: DataFrame) -> DataFrame:
    """The corner nodes of the cells, each once."""
    return equal_keys(shifted(cells.select(*KEY), CORNERS))


def dense(cells: DataFrame, low: Box, high: Box, value: str = "density") -> DataFrame:
    """(i, j, k, value) of every point of the half-open box, 0 where there is no cell."""
    own = cells.select(*KEY, F.col(value).alias("value"))
    return region(cells.sparkSession, low, high).join(own, KEY, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def from_field(stored: DataFrame, scaling: int = 1, value: str = "density") -> DataFrame:
    """The domain that stored cells make, those of value 0 too: each as scaling^3 cells, with the cube root as density."""
    at = [F.struct(*(F.lit(x).alias(n) for n, x in zip("xyz", o, strict=True))) for o in product(range(scaling), repeat=3)]
    fine = stored.select(*KEY, F.cbrt(value).alias("density")).withColumn("_o", F.explode(F.array(*at)))
    return fine.select(*((F.col(c) * scaling + F.col(f"_o.{x}")).cast("int").alias(c) for c, x in zip(KEY, "xyz", strict=True)), F.lit(INSIDE).cast("long").alias("flags"), "density")


def upscale(cells: DataFrame, coarse: DataFrame, bounds0: Box, scale: int, value: str = "density") -> DataFrame:
    """Each cell with the value of the coarse cell it falls in (nearest, the last axis one cell late).

    Both sides are fields, so they meet by a shuffle: Spark's estimate doesn't see that cells are made by
    exploding, and would broadcast all of them through the driver.
    """
    shift = (0, 0, scale - 1)
    keys = [F.expr(f"({c} - {b} + {s}) div {scale}").cast("int").alias(f"_{c}") for c, b, s in zip(KEY, bounds0, shift, strict=True)]
    src = coarse.select(*(F.col(c).alias(f"_{c}") for c in KEY), F.col(value).alias("value"))
    return cells.select(*KEY, *keys).join(src.hint("merge"), [f"_{c}" for c in KEY]).select(*KEY, "value")
