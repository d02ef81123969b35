"""Signed-distance predicates of position columns; a cell is populated where its centre's is at most EDGE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxmill.functions.grid import norm

EDGE = 1e-6
STEEP = {"wheel": (1 + 4.5**2) ** 0.5}  # how fast a domain's value can change with the distance, where that isn't 1
Sdf = Callable[[Column, Column, Column], Column]


def dense() -> Sdf:
    return lambda x, y, z: F.lit(-1.0)


def cylinder(radius: float = 0.4, thickness: float = 0.03, height: float = 1.0) -> Sdf:
    """A standing tube."""
    return lambda x, y, z: F.greatest(F.abs(y) - height / 2, F.abs(norm(x, z) - radius) - thickness / 2)


def wheel() -> Sdf:
    """A rim and a hub that gets thinner outwards."""

    def at(x: Column, y: Column, z: Column) -> Column:
        h = norm(x, y)
        return F.least(norm(h - 0.45, z) - 0.03, F.abs(h) + 4.5 * F.abs(z) - 0.45)

    return at


def box(size: tuple[float, float, float] = (0.3, 0.3, 0.3)) -> Sdf:
    return lambda x, y, z: F.greatest(*(F.abs(c) - s for c, s in zip((x, y, z), size, strict=True)))


def sphere(inner: float = 0.4, outer: float = 0.5, lower_only: bool = False, upper_only: bool = False) -> Sdf:
    """A shell, or its lower half."""
    if upper_only:
        raise ValueError("an upper half shell isn't supported")

    def at(x: Column, y: Column, z: Column) -> Column:
        d = F.greatest(norm(x, y, z) - outer, inner - norm(x, y, z))
        return F.greatest(d, y) if lower_only else d

    return at


def gripper(radius: float = 0.45, slit: float = 0.05) -> Sdf:
    """A ball with a slit from above."""
    return lambda x, y, z: F.greatest(norm(x, y, z) - radius, F.least(y, slit - F.abs(x)))


DOMAINS: dict[str, Callable[..., Sdf]] = {"dense": dense, "cylinder": cylinder, "wheel": wheel, "box": box, "sphere": sphere, "gripper": gripper}


def domain(name: str, **settings) -> Sdf:
    if name not in DOMAINS:
        raise ValueError(f"unknown domain {name!r}")
    at = DOMAINS[name](**settings)
    at.steep = STEEP.get(name, 1.0)  # so the values over a block are bounded by the one at its centre
    return at
