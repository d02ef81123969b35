"""Boundary conditions and loads: filters, neighbour scatters and aggregations."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import CORNERS, FIXED_DENSITY, HAS_FORCE, KEY, equal_keys, norm, shifted, to_position
from voxmill.functions.sdf import EDGE, Sdf
from voxmill.operators.region import nodes_of

Vector = tuple[float, float, float]
TOUCHING = [tuple(-x for x in c) for c in CORNERS]


def _force(f: Vector, weight: Column | None = None) -> list[Column]:
    return [(F.lit(float(x)) * weight if weight is not None else F.lit(float(x))).alias(c) for x, c in zip(f, ("fx", "fy", "fz"), strict=True)]


def node_force(cells: DataFrame, forces: DataFrame, dirichlet: DataFrame | None = None, fix: bool = False) -> tuple[DataFrame, DataFrame]:
    """The forces on nodes that touch a cell and aren't fixed, and the cells with their flags around them set."""
    good = forces.join(nodes_of(cells), KEY, "left_semi")
    if dirichlet is not None:
        good = good.join(equal_keys(dirichlet), KEY, "left_anti")
    touched = equal_keys(shifted(good.select(*KEY), TOUCHING)).withColumn("_on", F.lit(HAS_FORCE | (FIXED_DENSITY if fix else 0)).cast("long"))
    flags = F.col("flags").bitwiseOR(F.coalesce("_on", F.lit(0).cast("long")))
    return good, cells.join(touched, KEY, "left").withColumn("flags", flags).drop("_on")


def box_force(cells: DataFrame, centre: tuple[int, int, int], f: Vector, size: int) -> DataFrame:
    """The force split over size^3 nodes around the centre, as far as they touch a cell."""
    lo, hi = -(size // 2), size - size // 2
    box = [F.sequence(F.lit(c + lo), F.lit(c + hi - 1)) for c in centre]
    one = cells.sparkSession.range(1)
    for name, at in zip(KEY, box, strict=True):
        one = one.withColumn(name, F.explode(at))
    return one.join(nodes_of(cells), KEY, "left_semi").select(*KEY, *_force(tuple(x / size**3 for x in f)))


def load(cells: DataFrame, centre: tuple[int, int, int], f: Vector, size: float, dx: float) -> DataFrame:
    """box_force whose size is a length: as many nodes as cover it."""
    return box_force(cells, centre, f, ceil(size / dx))


def node_boundary(cells: DataFrame, records: DataFrame) -> DataFrame:
    """The records (i, j, k, axis, value) of nodes that touch a cell."""
    return records.join(nodes_of(cells), KEY, "left_semi")


def volume_load(nodes: DataFrame, f: Vector, inside: Column) -> DataFrame:
    """The whole force on every node inside a texture."""
    return nodes.where(inside).select(*KEY, *_force(f))


def make_shell(cells: DataFrame, dx: float, sdf: Sdf, grow: float = 1.03) -> DataFrame:
    """Cells whose centre, moved outwards by ``grow``, lies outside the domain get a fixed density."""
    out = sdf(*(to_position(F.col(c) + 0.5, dx) * grow for c in KEY)) > EDGE
    return cells.withColumn("flags", F.col("flags").bitwiseOR(F.when(out, FIXED_DENSITY).otherwise(0).cast("long")))


def plane_load(nodes: DataFrame, f: Vector, axis: int, at: int, where: Column | None = None) -> DataFrame:
    """The force shared equally by all nodes of a plane (within a predicate).

    Counted by a partial and a final aggregate; no row passes through one task.
    """
    on = nodes.where(F.col(KEY[axis]) == at)
    on = on if where is None else on.where(where)
    count = on.agg(F.count("*").alias("_n"))  # a single row
    return on.join(F.broadcast(count)).select(*KEY, *_force(f, 1.0 / F.col("_n")))


def bridge_load(cells: DataFrame, bottom: int) -> DataFrame:
    """A load of 1 downwards on the lowest cells' bottom faces, a quarter of each to every corner."""
    face = cells.where(F.col("j") == bottom)
    count = face.agg(F.count("*").alias("_n"))
    corners = [(0, 0, 0), (1, 0, 0), (0, 0, 1), (1, 0, 1)]
    share = shifted(face.select(*KEY), corners).groupBy(*KEY).agg(F.count("*").alias("_c"))
    return share.join(F.broadcast(count)).select(*KEY, *_force((0.0, -1.0, 0.0), F.col("_c") / 4.0 / F.col("_n")))


def column_load(nodes: DataFrame, dx: float, reach: float = 0.35, version: int = 2) -> DataFrame:
    """Pressure on the envelope of each (i, k) column: down on its top node and, in version 2, up on its lowest."""
    c = nodes.groupBy("i", "k").agg(F.min("j").alias("low"), F.max("j").alias("high"))
    c = c.where(F.abs(to_position(F.col("i"), dx)) < reach)
    ends = [F.struct(F.col("high").alias("j"), F.lit(-0.5).alias("fy"))] + ([F.struct(F.col("low").alias("j"), F.lit(1.0).alias("fy"))] if version == 2 else [])
    e = c.select("i", "k", F.explode(F.array(*ends)).alias("e"))
    return e.select("i", F.col("e.j").alias("j"), "k", F.lit(0.0).alias("fx"), F.col("e.fy").alias("fy"), F.lit(0.0).alias("fz"))


def cell_dirichlet(cells: DataFrame, axes: str = "xyz", value: float = 0.0) -> DataFrame:
    """Fixes all corners of the cells on the named axes."""
    fixed = shifted(cells.select(*KEY), CORNERS).withColumn("axis", F.explode(F.array(*(F.lit("xyz".index(a)) for a in axes))))
    return fixed.select(*KEY, "axis", F.lit(float(value)).alias("value"))


def plane_dirichlet(cells: DataFrame, axis: int, at: int, axes: str = "xyz", value: float = 0.0, where: Column | None = None) -> DataFrame:
    on = cells.where(F.col(KEY[axis]) == at)
    return cell_dirichlet(on if where is None else on.where(where), axes, value)


def ball_dirichlet(cells: DataFrame, centre: Vector, radius: float, dx: float, axes: str = "xyz", value: float = 0.0) -> DataFrame:
    """Fixes the cells with density whose centre lies within the radius, and a cell's width more."""
    d = norm(*(to_position(F.col(c) + 0.5, dx) - x for c, x in zip(KEY, centre, strict=True)))
    return cell_dirichlet(cells.where((d <= radius + dx) & (F.col("density") > 0)), axes, value)


def box_dirichlet(cells: DataFrame, low: Vector, high: Vector, dx: float, axes: str = "xyz", value: float = 0.0) -> DataFrame:
    inside = F.col("density") != 0
    for c, a, b in zip(KEY, low, high, strict=True):
        inside &= to_position(F.col(c) + 0.5, dx).between(a, b)
    return cell_dirichlet(cells.where(inside), axes, value)


def spar_dirichlet(cells: DataFrame, dx: float, sdf: Sdf, centre: tuple[float, float] = (-0.1765, -0.004), radius: float = 0.0691) -> DataFrame:
    """Fixes the cells whose lower corner lies in the domain and in a spar: a cylinder along z."""
    at = [to_position(F.col(c), dx) for c in KEY]
    in_spar = norm(*(x - c for x, c in zip(at[:2], centre, strict=True))) < radius
    return cell_dirichlet(cells.where((sdf(*at) < 0) & in_spar))


def box_load(nodes: DataFrame, low: Vector, high: Vector, f: Vector, dx: float) -> DataFrame:
    """The whole force on every node of a box."""
    inside = F.lit(True)
    for c, a, b in zip(KEY, low, high, strict=True):
        inside &= to_position(F.col(c), dx).between(a, b)
    return nodes.where(inside).select(*KEY, *_force(f))


def target_deformation(nodes: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], displacement: Vector, weight: float = 1.0) -> DataFrame:
    """(i, j, k, u0, u1, u2, weight): where the nodes of a box, without its upper ends, are meant to move."""
    inside = F.lit(True)
    for c, a, b in zip(KEY, low, high, strict=True):
        inside &= (F.col(c) >= a) & (F.col(c) < b)
    return nodes.where(inside).select(*KEY, *(F.lit(float(x)).alias(f"u{n}") for n, x in enumerate(displacement)), F.lit(float(weight)).alias("weight"))


def wheel_load(nodes: DataFrame, dx: float, shear: bool = False) -> DataFrame:
    """Tangential (or axial) unit-like forces on the rim."""
    x, y, z = (to_position(F.col(c), dx) for c in KEY)
    rim = nodes.where((norm(x, y) > 0.42) & (norm(norm(x, y) - 0.45, z) - 0.03 < 0))
    f = [F.lit(0.0), F.lit(0.0), F.lit(1.0)] if shear else [-y, x, F.lit(0.0)]
    return rim.select(*KEY, *(v.alias(c) for v, c in zip(f, ("fx", "fy", "fz"), strict=True)))


def unique_dirichlet(records: DataFrame) -> DataFrame:
    """One record for each node and axis; contradicting values stop the job."""
    r = records.groupBy(*KEY, "axis").agg(F.min("value").alias("value"), F.max("value").alias("_most"))
    bad = F.raise_error(F.lit("contradicting Dirichlet values on a node")).cast("double")
    return r.withColumn("value", F.when(F.col("value") == F.col("_most"), F.col("value")).otherwise(bad)).drop("_most")


def fixed_cells(dirichlet: DataFrame) -> DataFrame:
    """(i, j, k, axis): cells all of whose eight corners are fixed on the axis."""
    d = dirichlet.select(*KEY, "axis").distinct()
    return shifted(d, TOUCHING).groupBy(*KEY, "axis").agg(F.count("*").alias("_n")).where("_n = 8").drop("_n")


def right_hand_side(forces: DataFrame, accumulate: bool = False) -> DataFrame:
    """Force of each node: the record of the largest seq, or the sum of all."""
    if accumulate:
        return forces.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("fx", "fy", "fz")))
    last = F.max_by(F.struct("fx", "fy", "fz"), "seq").alias("f")
    return forces.groupBy(*KEY).agg(last).select(*KEY, "f.fx", "f.fy", "f.fz")


def preset_density(cells: DataFrame, dx: float, kind: str) -> DataFrame:
    """Density patterns that tests begin from: island, cylinder, arch."""
    x, y, z = (to_position(F.col(c) + 0.5, dx) for c in KEY)
    inside = {"island": (x < -0.25) | ((x > 0) & (F.abs(y) < 0.1) & (F.abs(z) < 0.1)), "cylinder": norm(x, z) < 0.25, "arch": F.abs(norm(x, y + 0.5) - 0.4) < 0.1}[kind]
    return cells.withColumn("density", F.when(inside, 1.0).otherwise(0.0))
