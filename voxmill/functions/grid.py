"""Coordinate expressions, neighbour offsets and flag bits, all as Spark columns."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["i", "j", "k"]
PADDING = 8  # cells between the grid's edge and its domain
BLOCK = (4, 4, 4)
CORNERS = list(product((0, 1), repeat=3))  # in local node order, 4x + 2y + z
DIAGONALS = list(product((-1, 1), repeat=3))
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
AROUND = list(product((-1, 0, 1), repeat=3))

INSIDE, HAS_FORCE, FIXED_DENSITY, VISITED, HAS_DIRICHLET = 1, 2, 4, 8, 16
ACTIVE_NODE, DIRICHLET_NODE = 0x10, (0x20, 0x40, 0x80)
ACTIVE_CELL, DIRICHLET_CELL = 0x100, (0x200, 0x400, 0x800)


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def shifted(df: DataFrame, offsets: list[tuple[int, int, int]], weights: list | None = None) -> DataFrame:
    """Each row once for every offset, its key moved there; with a column w if there are weights.

    The offsets are literals, so the rows are made in the scan's own stage.
    """
    rows = [F.struct(*(F.lit(v).alias(c) for c, v in zip("xyz", o, strict=True)), F.lit(w).cast("double").alias("w")) for o, w in zip(offsets, weights or [1.0] * len(offsets), strict=True)]
    out = df.withColumn("_o", F.explode(F.array(*rows)))
    moved = {c: (F.col(c) + F.col(f"_o.{o}")).cast("int") for c, o in zip(KEY, "xyz", strict=True)}
    return out.withColumns(moved | ({"w": F.col("_o.w")} if weights else {})).drop("_o")


def with_block(df: DataFrame, size: tuple[int, int, int] = BLOCK) -> DataFrame:
    """Adds the block key bi, bj, bk."""
    return df.withColumns({f"b{c}": F.floor(F.col(c) / n).cast("int") for c, n in zip(KEY, size, strict=True)})


BLOCK_KEY = ["bi", "bj", "bk"]


def to_position(index: Column, dx: float) -> Column:
    """Position of a grid index in the unit domain around 0."""
    return (index - PADDING) * F.lit(dx) - 0.5


def to_index(position: Column, dx: float) -> Column:
    """Grid index of a position, truncated toward zero."""
    return ((position + 0.5) / F.lit(dx)).cast("int") + PADDING


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    to = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.least(F.greatest(x, to(low)), to(high))


def equal_keys(df: DataFrame) -> DataFrame:
    """The keys of a table, each once."""
    return df.select(*KEY).distinct()
