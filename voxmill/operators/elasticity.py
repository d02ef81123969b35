"""Linear elasticity on cells: element matrix, matrix-free product, compliance and its gradient."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import CORNERS, KEY, shifted

U = ["u0", "u1", "u2"]


def lame(youngs: float, poisson: float) -> tuple[float, float]:
    """(mu, lambda) of an isotropic material."""
    return youngs / (2 * (1 + poisson)), youngs * poisson / ((1 + poisson) * (1 - 2 * poisson))


def youngs(mu: float, lam: float) -> tuple[float, float]:
    """(E, nu) of Lamé's parameters."""
    return mu * (3 * lam + 2 * mu) / (lam + mu), lam / (2 * (lam + mu))


def element_matrix(mu: float, lam: float) -> np.ndarray:
    """The 24 x 24 stiffness of a unit cell by two-point Gauss quadrature; row 3 * corner + component."""
    points = (np.array(CORNERS) * 2 - 1) / np.sqrt(3) / 2 + 0.5
    corners = np.array(CORNERS)
    out = np.zeros((8, 3, 8, 3))
    for p in points:
        one = np.where(corners == 1, p, 1 - p)  # shape functions by axis
        g = np.stack([np.where(corners[:, a] == 1, 1, -1) * np.delete(one, a, 1).prod(1) for a in range(3)])
        out += lam * np.einsum("pi,qj->ipjq", g, g) + mu * np.einsum("qi,pj->ipjq", g, g) + mu * np.einsum("ki,kj,pq->ipjq", g, g, np.eye(3))
    return out.reshape(24, 24) / 8


def stiffness(density: Column, penalty: float = 3.0, least: float = 1e-9, minimum: float = 0.0) -> Column:
    """Share of the full material's stiffness; the density itself without a penalty."""
    if penalty == 0:
        return density
    return (1 - least) * F.pow(F.greatest(density, F.lit(minimum)), F.lit(float(penalty))) + least


def cell_vectors(cells: DataFrame, nodes: DataFrame, names: list[str] = U, keep: list[str] | None = None) -> DataFrame:
    """Each cell with its corners' values as one array of 24; missing nodes are 0."""
    corner = F.posexplode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "xyz", strict=True))) for c in CORNERS)))
    keep = keep or []
    at = cells.select(*(F.col(c).alias(f"c{c}") for c in KEY), *keep, corner.alias("corner", "_o"))
    at = at.select("ci", "cj", "ck", *keep, "corner", *((F.col(f"c{c}") + F.col(f"_o.{o}")).cast("int").alias(c) for c, o in zip(KEY, "xyz", strict=True)))
    values = F.array(*(F.coalesce(n, F.lit(0.0)) for n in names))
    got = at.join(nodes.select(*KEY, *names), KEY, "left").select("ci", "cj", "ck", *keep, "corner", values.alias("v"))
    vector = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("corner", "v"))), lambda x: x["v"]))
    first = [F.first(c).alias(c) for c in keep]
    return got.groupBy("ci", "cj", "ck").agg(vector.alias("v"), *first).select(F.col("ci").alias("i"), F.col("cj").alias("j"), F.col("ck").alias("k"), *keep, "v")


def _times(batch: pa.RecordBatch, column: str, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column(column)
    x = np.asarray(v.flatten()).reshape(len(v), 24)
    return x, x @ matrix


def multiply(cells: DataFrame, nodes: DataFrame, mu: float, lam: float, dx: float = 1.0, scale: str = "scale", names: list[str] = U) -> DataFrame:
    """K u without a matrix: each cell's forces on its corners, summed at the nodes; columns f0, f1, f2."""
    matrix = element_matrix(mu, lam) * dx

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _times(b, "v", matrix)[1] * np.asarray(b.column(scale))[:, None]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), 24).cast(pa.list_(pa.float64()))], names=[*KEY, "f"])

    forces = cell_vectors(cells, nodes, names, [scale]).select(*KEY, scale, "v").mapInArrow(run, "i int, j int, k int, f array<double>")
    corners = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "xyz", strict=True)), *(F.col("f")[3 * m + a].alias(f"f{a}") for a in range(3))) for m, c in enumerate(CORNERS)))
    to = forces.select(*KEY, F.explode(corners).alias("o"))
    to = to.select(*((F.col(c) + F.col(f"o.{o}")).cast("int").alias(c) for c, o in zip(KEY, "xyz", strict=True)), *(F.col(f"o.f{a}").alias(f"f{a}") for a in range(3)))
    return to.groupBy(*KEY).agg(*(F.sum(f"f{a}").alias(f"f{a}") for a in range(3)))


def energies(cells: DataFrame, nodes: DataFrame, mu: float, lam: float, density: str = "density") -> DataFrame:
    """(i, j, k, density, s): the elastic energy u^T K u of each cell with full material."""
    matrix = element_matrix(mu, lam)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, kx = _times(b, "v", matrix)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), b.column(density), pa.array((x * kx).sum(1))], names=[*KEY, density, "s"])

    return cell_vectors(cells, nodes, U, [density]).select(*KEY, density, "v").mapInArrow(run, f"i int, j int, k int, {density} double, s double")


def compliance(cells: DataFrame, nodes: DataFrame, mu: float, lam: float, penalty: float = 3.0, least: float = 1e-9, weight: float = 1.0) -> DataFrame:
    """(i, j, k, density, part, dc0): each cell's share of the objective, and the gradient."""
    d, s = F.col("density"), F.col("s")
    e = energies(cells, nodes, mu, lam)
    part = weight * s * (least + F.pow(d, F.lit(float(penalty))) * (1 - least))
    return e.select(*KEY, "density", part.alias("part"), (-weight * s * penalty * F.pow(d, F.lit(float(penalty - 1))) * (1 - least)).alias("dc0"))


def diagonal(cells: DataFrame, mu: float, lam: float, dx: float = 1.0, scale: str = "scale") -> DataFrame:
    """(i, j, k, d0, d1, d2): the diagonal of K at the nodes; every corner of a cell has the same."""
    d = np.diag(element_matrix(mu, lam) * dx)[:3]
    to = shifted(cells.select(*KEY, scale), CORNERS).groupBy(*KEY).agg(F.sum(scale).alias("_s"))
    return to.select(*KEY, *((F.col("_s") * float(v)).alias(f"d{a}") for a, v in enumerate(d)))
