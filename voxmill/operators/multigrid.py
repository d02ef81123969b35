"""Two-level multigrid: Galerkin coarse cells and a symmetric V-cycle, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import AROUND, CORNERS, KEY, shifted
from voxmill.operators.elasticity import cell_vectors, element_matrix, multiply
from voxmill.session import checkpoint

WEIGHTS = [0.5 ** sum(map(abs, o)) for o in AROUND]


def level_sizes(res: tuple[int, int, int], levels: int) -> list[tuple[int, int, int]]:
    """Cells of each level: every one half as many, rounded up."""
    out = [res]
    for _ in range(levels - 1):
        out.append(tuple(-(-n // 2) for n in out[-1]))
    return out


def restrict_vectors(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Residuals to the coarse nodes: each collects the fine nodes around it, near ones more."""
    moved = shifted(nodes.select(*KEY, *names), AROUND, WEIGHTS).where("i % 2 = 0 and j % 2 = 0 and k % 2 = 0")
    return moved.groupBy(*((F.expr(f"{c} div 2")).cast("int").alias(c) for c in KEY)).agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))


def prolong_vectors(coarse: DataFrame, fine: DataFrame, names: list[str]) -> DataFrame:
    """Corrections at the keys of ``fine``: copied at even nodes, averaged at odd ones."""
    twice = coarse.select(*((F.col(c) * 2).cast("int").alias(c) for c in KEY), *names)
    sent = shifted(twice, AROUND, WEIGHTS).groupBy(*KEY).agg(*(F.sum(F.col("w") * F.col(n)).alias(n) for n in names))
    return fine.select(*KEY).join(sent, KEY, "left").select(*KEY, *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names))


def cell_transfer(child: tuple[int, int, int]) -> np.ndarray:
    """24 x 24: the corner values of one of a coarse cell's eight children from the coarse corners, trilinearly."""
    t = np.zeros((8, 8))
    for m, c in enumerate(CORNERS):
        at = (np.array(child) + c) / 2
        for n, d in enumerate(CORNERS):
            t[m, n] = np.prod(np.where(np.array(d) == 1, at, 1 - at))
    return np.kron(t, np.eye(3))


def coarse_cells(cells: DataFrame, mu: float, lam: float, dx: float = 1.0, scale: str = "scale") -> DataFrame:
    """(i, j, k, a): Galerkin matrices of the coarse cells as arrays of 576.

    Sums of the children's stiffness times eight constant matrices, one for each
    place in the coarse cell; the sums are made before the shuffle.
    """
    e = element_matrix(mu, lam) * dx
    parts = [cell_transfer(c).T @ e @ cell_transfer(c) for c in CORNERS]
    place = sum((F.col(c) % 2 * w for c, w in zip(KEY[1:], (2, 1), strict=True)), F.col("i") % 2 * 4)
    sums = cells.groupBy(*(F.expr(f"{c} div 2").cast("int").alias(c) for c in KEY)).agg(*(F.sum(F.when(place == n, F.col(scale)).otherwise(0.0)).alias(f"s{n}") for n in range(8)))
    flat = np.stack([p.ravel() for p in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                a = np.stack([np.asarray(part.column(f"s{n}")) for n in range(8)], 1) @ flat
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), 576).cast(pa.list_(pa.float64()))], names=[*KEY, "a"])

    return sums.mapInArrow(run, "i int, j int, k int, a array<double>")


def coarse_multiply(coarse: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """A u on the coarse level, with each cell's own matrix; columns f0, f1, f2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                n = part.num_rows
                a, v = (np.asarray(part.column(c).flatten()) for c in ("a", "v"))
                f = np.einsum("nij,nj->ni", a.reshape(n, 24, 24), v.reshape(n, 24))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), 24).cast(pa.list_(pa.float64()))], names=[*KEY, "f"])

    forces = cell_vectors(coarse, nodes, names, ["a"]).select(*KEY, "a", "v").mapInArrow(run, "i int, j int, k int, f array<double>")
    corners = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "xyz", strict=True)), *(F.col("f")[3 * m + a].alias(f"f{a}") for a in range(3))) for m, c in enumerate(CORNERS)))
    to = forces.select(*KEY, F.explode(corners).alias("o"))
    to = to.select(*((F.col(c) + F.col(f"o.{o}")).cast("int").alias(c) for c, o in zip(KEY, "xyz", strict=True)), *(F.col(f"o.f{a}").alias(f"f{a}") for a in range(3)))
    return to.groupBy(*KEY).agg(*(F.sum(f"f{a}").alias(f"f{a}") for a in range(3)))


def coarse_diagonal(coarse: DataFrame) -> DataFrame:
    """(i, j, k, d0, d1, d2) of the coarse matrices."""
    corner = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "xyz", strict=True)), *(F.col("a")[25 * (3 * m + q)].alias(f"d{q}") for q in range(3))) for m, c in enumerate(CORNERS)))
    to = coarse.select(*KEY, F.explode(corner).alias("o"))
    to = to.select(*((F.col(c) + F.col(f"o.{o}")).cast("int").alias(c) for c, o in zip(KEY, "xyz", strict=True)), *(F.col(f"o.d{q}").alias(f"d{q}") for q in range(3)))
    return to.groupBy(*KEY).agg(*(F.sum(f"d{q}").alias(f"d{q}") for q in range(3)))


def _three(name: str) -> list[str]:
    return [f"{name}{a}" for a in range(3)]


def v_cycle(cells: DataFrame, mu: float, lam: float, dx: float = 1.0, scale: str = "scale", damping: float = 0.4, coarse_steps: int = 4) -> Callable[[DataFrame], DataFrame]:
    """A symmetric two-level preconditioner for ``krylov.solve``.

    A damped Jacobi step, a coarse correction by some more on the Galerkin matrices,
    and the first step again: symmetric, as conjugate gradients need. Fixed nodes
    take no correction on either level.
    """
    coarse = checkpoint(coarse_cells(cells, mu, lam, dx, scale))
    free = lambda a, v: F.when(F.col(f"g{a}").isNull(), v).otherwise(0.0)
    jacobi = lambda a, r: F.when(F.col(f"d{a}") != 0, F.lit(damping) * r / F.col(f"d{a}")).otherwise(0.0)

    def left_over(df: DataFrame, product: DataFrame, rhs: str, to: str) -> DataFrame:
        got = df.join(product, KEY, "left")
        return got.withColumns({f"{to}{a}": free(a, F.col(f"{rhs}{a}") - F.coalesce(f"f{a}", F.lit(0.0))) for a in range(3)}).drop(*_three("f"))

    def apply(nodes: DataFrame) -> DataFrame:
        n = nodes.select(*KEY, *_three("r"), *_three("d"), *_three("g"))
        n = n.withColumns({f"z{a}": free(a, jacobi(a, F.col(f"r{a}"))) for a in range(3)})
        n = checkpoint(left_over(n, multiply(cells, n, mu, lam, dx, scale, _three("z")), "r", "q"))
        held = n.where("i % 2 = 0 and j % 2 = 0 and k % 2 = 0").select(*(F.expr(f"{c} div 2").cast("int").alias(c) for c in KEY), *_three("g"))
        c = restrict_vectors(n, _three("q")).join(coarse_diagonal(coarse), KEY).join(held, KEY, "left")
        c = c.withColumns({f"q{a}": free(a, F.col(f"q{a}")) for a in range(3)} | {f"e{a}": F.lit(0.0) for a in range(3)})
        c = checkpoint(c.withColumns({f"p{a}": F.col(f"q{a}") for a in range(3)}))
        for step in range(coarse_steps):
            c = c.withColumns({f"e{a}": F.col(f"e{a}") + free(a, jacobi(a, F.col(f"p{a}"))) for a in range(3)})
            if step + 1 < coarse_steps:
                c = checkpoint(left_over(c, coarse_multiply(coarse, c, _three("e")), "q", "p"))
        up = prolong_vectors(c, n, _three("e"))
        n = n.join(up, KEY).withColumns({f"z{a}": F.col(f"z{a}") + free(a, F.col(f"e{a}")) for a in range(3)}).drop(*_three("e"))
        n = checkpoint(left_over(n, multiply(cells, n, mu, lam, dx, scale, _three("z")), "r", "q"))
        return n.select(*KEY, *((F.col(f"z{a}") + free(a, jacobi(a, F.col(f"q{a}")))).alias(f"z{a}") for a in range(3)))

    return apply
