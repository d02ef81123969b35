"""The narrow band: statistics of blocks, which ones stay, and how they grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import BLOCK, BLOCK_KEY, CORNERS, DIAGONALS, HAS_FORCE, KEY, has, shifted, with_block
from voxmill.operators.search import ranked

Box = tuple[int, int, int]


def block_stats(cells: DataFrame, size: Box = BLOCK) -> DataFrame:
    """Least, largest and summed density of each block and whether a force acts in it."""
    force = F.bool_or(has(F.col("flags"), HAS_FORCE)) if "flags" in cells.columns else F.lit(False)
    return with_block(cells, size).groupBy(*BLOCK_KEY).agg(F.min("density").alias("density_min"), F.max("density").alias("density_max"), F.sum("density").alias("density_sum"), force.alias("has_force"))


def thin(cells: DataFrame, minimum: float = 0.0, threshold: float = 1e-6, size: Box = BLOCK) -> DataFrame:
    """Blocks with a density worth keeping, or a force."""
    return block_stats(cells, size).where((F.col("density_max") >= minimum + threshold) | F.col("has_force"))


def densest(cells: DataFrame, fraction: float, containers: int, size: Box = BLOCK) -> DataFrame:
    """The share of blocks with the largest summed density; ties by key. Sums count to nine digits, as they depend on their order."""
    stats = block_stats(cells, size).withColumn("density_sum", F.round("density_sum", 9))
    return ranked(stats, F.col("density_sum").desc(), *BLOCK_KEY).where(F.col("place") < int(fraction * containers)).drop("place")


def fat(cells: DataFrame, thin_blocks: DataFrame, container: DataFrame, margin: int = 1, threshold: float = 1e-6, size: Box = BLOCK) -> DataFrame:
    """Blocks that a dense cell of a thin block reaches with its eight diagonal neighbours."""
    dense = with_block(cells, size).where(F.col("density") > threshold).join(thin_blocks, BLOCK_KEY, "left_semi").select(*KEY)
    reach = with_block(shifted(dense, [tuple(margin * x for x in d) for d in DIAGONALS]), size).select(*BLOCK_KEY).distinct()
    return reach.join(container, BLOCK_KEY, "left_semi")


def fatter(fat_blocks: DataFrame, container: DataFrame) -> DataFrame:
    """The fat blocks and their upper neighbours."""
    moved = shifted(fat_blocks.select(*(F.col(b).alias(c) for b, c in zip(BLOCK_KEY, KEY, strict=True))), CORNERS).distinct()
    return moved.select(*(F.col(c).alias(b) for b, c in zip(BLOCK_KEY, KEY, strict=True))).join(container, BLOCK_KEY, "left_semi")


def active_counts(cells: DataFrame, blocks: DataFrame, threshold: float = 1e-6, size: Box = BLOCK) -> DataFrame:
    """One row: cells of the blocks and those over the threshold."""
    own = with_block(cells, size).join(blocks, BLOCK_KEY, "left_semi")
    return own.agg(F.count("*").alias("cells"), F.count_if(F.col("density") > threshold).alias("active"))


def solver_density(cells: DataFrame, fatter_blocks: DataFrame, fat_blocks: DataFrame, size: Box = BLOCK) -> DataFrame:
    """What a solver gets: fat cells never quite empty, cells of the outer blocks empty."""
    own = with_block(cells, size).join(fatter_blocks, BLOCK_KEY, "left_semi")
    mark = fat_blocks.select(*BLOCK_KEY).distinct().withColumn("_fat", F.lit(True))
    value = F.when(F.col("_fat"), F.greatest("density", F.lit(2.2250738585072014e-308))).otherwise(0.0)
    return own.join(mark, BLOCK_KEY, "left").select(*KEY, value.alias("density"))


def clear_gradients(cells: DataFrame, fat_blocks: DataFrame, gradient: str = "dc0", size: Box = BLOCK) -> DataFrame:
    """The cells with a gradient of 0 in the fat blocks."""
    mark = fat_blocks.select(*BLOCK_KEY).distinct().withColumn("_fat", F.lit(True))
    own = with_block(cells, size).join(mark, BLOCK_KEY, "left")
    return own.withColumn(gradient, F.when(F.col("_fat"), 0.0).otherwise(F.col(gradient))).drop("_fat", *BLOCK_KEY)


def block_state(container: DataFrame, thin_blocks: DataFrame, fat_blocks: DataFrame, fatter_blocks: DataFrame) -> DataFrame:
    """(bi, bj, bk, container, thin, fat, fatter): all sets of blocks as one table of marks; one aggregation refreshes it."""
    names = ("container", "thin", "fat", "fatter")
    every = None
    for n, blocks in enumerate((container, thin_blocks, fat_blocks, fatter_blocks)):
        own = blocks.select(*BLOCK_KEY, F.lit(1 << n).alias("mark"))
        every = own if every is None else every.union(own)
    marks = every.groupBy(*BLOCK_KEY).agg(F.bit_or("mark").alias("mark"))
    return marks.select(*BLOCK_KEY, *((F.col("mark").bitwiseAND(F.lit(1 << n)) != 0).alias(name) for n, name in enumerate(names)))
