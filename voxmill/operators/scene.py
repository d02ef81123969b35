"""Scenes: trees of domains that are asked in one pass over the cells.

A leaf is a distance function, a texture, a stored field or a closed mesh; trees
join them by union, intersection and difference. Each further leaf that isn't a function
costs one join of the cells; all parts of a scene share them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import KEY, to_position
from voxmill.functions.sdf import EDGE, Sdf
from voxmill.operators import texture
from voxmill.sources import mesh

Places = tuple[Column, Column, Column]


@dataclass(eq=False)
class Shape:
    """The points whose value is 0 at most; positions from -0.5 to 0.5."""

    sdf: Sdf


@dataclass(eq=False)
class Texture:
    """The points where a stored grid's trilinear value reaches a level."""

    stored: DataFrame
    res: tuple[int, int, int]
    value: str = "density"
    level: float = 0.5


@dataclass(eq=False)
class Field:
    """The cells that a stored field has."""

    stored: DataFrame


@dataclass(eq=False)
class Mesh:
    """The cells whose centre lies in a closed mesh of triangles (fid, ax..cz)."""

    triangles: DataFrame


@dataclass(eq=False)
class Tree:
    kind: str
    parts: tuple


def union(*parts) -> Tree:
    return Tree("union", parts)


def intersection(*parts) -> Tree:
    return Tree("intersection", parts)


def difference(whole, *less) -> Tree:
    return Tree("difference", (whole, *less))


def leaves(part) -> list:
    return [x for p in part.parts for x in leaves(p)] if isinstance(part, Tree) else [part]


def holds(part, of: Callable[[object], Column]) -> Column:
    """Whether a tree holds a cell, from whether its leaves do."""
    if not isinstance(part, Tree):
        return of(part)
    own = [holds(p, of) for p in part.parts]
    out = own[0]
    for x in own[1:]:
        out = out | x if part.kind == "union" else out & x if part.kind == "intersection" else out & ~x
    return out


def members(cells: DataFrame, parts: dict[str, object], dx: float, at: Places | None = None) -> DataFrame:
    """The cells with a column for each named tree that tells whether it holds the cell.

    ``at`` gives positions from -0.5 to 0.5, else they follow from ``dx``. Meshes use dx. Cells are
    told apart by i, j, k and have to be there once each.
    """
    at = at or tuple(to_position(F.col(c) + 0.5, dx) for c in KEY)
    every = list({id(x): x for p in parts.values() for x in leaves(p)}.values())
    known: dict[int, Column] = {}
    out = cells
    for n, leaf in enumerate(every):
        name = f"_leaf{n}"
        if isinstance(leaf, Shape):
            known[id(leaf)] = leaf.sdf(*at) <= EDGE
            continue
        if isinstance(leaf, Texture):
            out = texture.sample(out, leaf.stored, leaf.res, tuple(p + 0.5 for p in at), leaf.value, name)
            known[id(leaf)] = texture.inside(name, leaf.level)
            continue
        own = leaf.stored.select(*KEY).distinct() if isinstance(leaf, Field) else mesh.inside(leaf.triangles, cells.select(*KEY), dx).select(*KEY)
        out = out.join(own.withColumn(name, F.lit(True)), KEY, "left")
        known[id(leaf)] = F.coalesce(F.col(name), F.lit(False))
    out = out.withColumns({k: holds(p, lambda x: known[id(x)]) for k, p in parts.items()})
    return out.drop(*(f"_leaf{n}" for n in range(len(every))))


def declared(cells: DataFrame, domain, dx: float, fixed=None, loaded=None, force: tuple[float, float, float] = (0.0, -1.0, 0.0), at: Places | None = None) -> DataFrame:
    """(i, j, k, fixed, fx, fy, fz): the domain's cells, whether ``fixed`` holds them, and the force on those that ``loaded`` holds (null on others)."""
    none = Shape(lambda x, y, z: F.lit(1.0))
    found = members(cells, {"_in": domain, "fixed": fixed or none, "_on": loaded or none}, dx, at).where("_in")
    return found.select(*KEY, "fixed", *(F.when(F.col("_on"), F.lit(float(f))).alias(c) for f, c in zip(force, ("fx", "fy", "fz"), strict=True)))


def counts(declared_cells: DataFrame) -> dict[str, Column]:
    """Aggregates of ``declared`` that a write can observe."""
    return {"cells": F.count("*"), "fixed": F.count_if("fixed"), "loaded": F.count_if(F.col("fx").isNotNull())}
