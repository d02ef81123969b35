"""Flags of cells and nodes, and the checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import ACTIVE_CELL, AROUND, CORNERS, DIRICHLET_CELL, DIRICHLET_NODE, KEY, equal_keys, has, shifted, with_block
from voxmill.session import checkpoint


def flag_nodes(cells: DataFrame) -> DataFrame:
    """(i, j, k, flags): to each node the flags of the cells around it, moved down four bits."""
    down = cells.select(*KEY, F.shiftrightunsigned("flags", 4).alias("flags"))
    return shifted(down, CORNERS).groupBy(*KEY).agg(F.bit_or("flags").alias("flags"))


def boundary_band(nodes: DataFrame, fixed: DataFrame, passes: int = 3) -> DataFrame:
    """Nodes within ``passes`` steps of a fixed node over nodes that aren't fixed.

    Each pass starts from what the pass before had reached. A pass reaches its own
    nodes again, so the passes are one chain of scatters and joins.
    """
    fixed = equal_keys(fixed)
    free = checkpoint(equal_keys(nodes).join(fixed, KEY, "left_anti"))
    band = fixed
    for _ in range(passes):
        band = equal_keys(shifted(band, AROUND)).join(free, KEY, "left_semi")
    return band


def blocks_of(nodes: DataFrame, size: tuple[int, int, int] = (4, 4, 4)) -> DataFrame:
    """The blocks that hold a node."""
    return with_block(nodes, size).select("bi", "bj", "bk").distinct()


def active_cells(cells: DataFrame, value: str = "mu") -> DataFrame:
    """Sets ACTIVE_CELL where the stiffness isn't 0."""
    on = F.when(F.coalesce(F.col(value) != 0, F.lit(False)), ACTIVE_CELL).otherwise(0).cast("long")
    return cells.withColumn("flags", F.col("flags").bitwiseOR(on))


def dirichlet_cells(cells: DataFrame, fixed: DataFrame) -> DataFrame:
    """Sets the bits of the axes that ``fixed`` (i, j, k, axis) names for a cell."""
    bit = F.element_at(F.array(*map(F.lit, DIRICHLET_CELL)), F.col("axis") + 1).cast("long")
    bits = fixed.groupBy(*KEY).agg(F.bit_or(bit).alias("_on"))
    return cells.join(bits, KEY, "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("_on", F.lit(0).cast("long")))).drop("_on")


def dirichlet_list(nodes: DataFrame, bits: tuple[int, int, int]) -> DataFrame:
    """(i, j, k, axis): one row for every fixed axis of a node."""
    axes = F.array(*(F.when(has(F.col("flags"), b), F.lit(a)) for a, b in enumerate(bits)))
    return nodes.select(*KEY, F.explode(F.array_compact(axes)).alias("axis"))


def outside_blocks(cells: DataFrame, blocks: DataFrame, size: tuple[int, int, int] = (4, 4, 4)) -> DataFrame:
    """Upper neighbours of cells whose block isn't in ``blocks``; none may be left."""
    upper = with_block(equal_keys(shifted(cells.select(*KEY), CORNERS)), size)
    return upper.join(blocks, ["bi", "bj", "bk"], "left_anti")


def out_of_padding(blocks: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Blocks that touch the low side or one of the last two of the high side; none may be left."""
    bad = [(F.col(b) < 1) | (F.col(b) >= n - 2) for b, n in zip(("bi", "bj", "bk"), size, strict=True)]
    return blocks.where(bad[0] | bad[1] | bad[2])


def coarsen_flags(cells: DataFrame, pad: tuple[int, int, int] = (4, 4, 4)) -> DataFrame:
    """One multigrid level up: a cell has the flags that any of its children has."""
    half = [(F.floor((F.col(c) - p) / 2) + p).cast("int").alias(c) for c, p in zip(KEY, pad, strict=True)]
    return cells.select(*half, "flags").groupBy(*KEY).agg(F.bit_or("flags").alias("flags"))


LEVEL = "level"


def hierarchy(cells: DataFrame, levels: int, pad: tuple[int, int, int] = (4, 4, 4)) -> DataFrame:
    """(level, i, j, k, flags) of all levels, 0 the cells themselves; each further level halves the last.

    Active and fixed bits of a cell rise to all cells over it. Every level comes from
    the finest one, so that the whole is one scatter and one aggregation.
    """
    rise = ACTIVE_CELL | DIRICHLET_CELL[0] | DIRICHLET_CELL[1] | DIRICHLET_CELL[2]
    every = cells.select(*KEY, "flags", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias(LEVEL))
    up = {c: (F.expr(f"shiftright({c} - {p}, {LEVEL})") + p).cast("int") for c, p in zip(KEY, pad, strict=True)}
    flags = F.when(F.col(LEVEL) == 0, F.col("flags")).otherwise(F.col("flags").bitwiseAND(F.lit(rise)))
    return every.withColumns(up | {"flags": flags}).where((F.col(LEVEL) == 0) | (F.col("flags") != 0)).groupBy(LEVEL, *KEY).agg(F.bit_or("flags").alias("flags"))


def hierarchy_nodes(every: DataFrame) -> DataFrame:
    """(level, i, j, k, flags): flag_nodes of all levels at once."""
    down = every.select(LEVEL, *KEY, F.shiftrightunsigned("flags", 4).alias("flags"))
    return shifted(down, CORNERS).groupBy(LEVEL, *KEY).agg(F.bit_or("flags").alias("flags"))


def hierarchy_blocks(every: DataFrame, size: tuple[int, int, int] = (4, 4, 4)) -> DataFrame:
    """(level, bi, bj, bk): at level 0 the cells' blocks, above it those of active cells with their seven upper neighbours, and the neighbours' of fixed ones."""
    active = shifted(every.where((F.col(LEVEL) > 0) & has(F.col("flags"), ACTIVE_CELL)).select(LEVEL, *KEY), CORNERS)
    fixed = shifted(every.where((F.col(LEVEL) > 0) & (F.col("flags").bitwiseAND(F.lit(sum(DIRICHLET_CELL))) != 0)).select(LEVEL, *KEY), CORNERS[1:])
    own = every.where(F.col(LEVEL) == 0).select(LEVEL, *KEY)
    return with_block(own.union(active).union(fixed), size).select(LEVEL, "bi", "bj", "bk").distinct()


def hierarchy_band(nodes: DataFrame, passes: int = 3) -> DataFrame:
    """(level, i, j, k): nodes of all levels within ``passes`` steps of a fixed node, over nodes that aren't fixed."""
    fixed_bits = has(F.col("flags"), sum(DIRICHLET_NODE))
    key = [LEVEL, *KEY]
    free = checkpoint(nodes.where(~fixed_bits).select(*key))
    band = nodes.where(fixed_bits).select(*key)
    for _ in range(passes):
        band = shifted(band, AROUND).select(*key).distinct().join(free, key, "left_semi")
    return band


def value_check(df: DataFrame, value: str) -> DataFrame:
    """One row: number of values, of NaNs, of infinities, and the least and largest of the others but 0."""
    v = F.col(value)
    good = ~F.isnan(v) & (F.abs(v) != float("inf"))
    return df.agg(
        F.count(v).alias("n"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infinities"),
        F.min(F.when(good & (v != 0), v)).alias("least"), F.max(F.when(good & (v != 0), v)).alias("largest"),
    )
