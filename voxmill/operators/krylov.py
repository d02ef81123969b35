"""Preconditioned conjugate gradients over one node table; a driver loop of joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import KEY
from voxmill.operators.elasticity import U, diagonal, multiply
from voxmill.operators.region import nodes_of
from voxmill.session import checkpoint


@dataclass
class Solution:
    nodes: DataFrame  # i, j, k, u0, u1, u2
    residuals: list[float] = field(default_factory=list)
    success: bool = False


def _columns(name: str) -> list[str]:
    return [f"{name}{a}" for a in range(3)]


def solve(
    cells: DataFrame, forces: DataFrame, fixed: DataFrame, mu: float, lam: float, dx: float = 1.0, tolerance: float = 1e-4, max_iterations: int = 500, scale: str = "scale",
    precondition: Callable[[DataFrame], DataFrame] | None = None,
) -> Solution:
    """Solves K u = f with u given on (i, j, k, axis, value) of ``fixed``.

    ``precondition`` makes (i, j, k, z0, z1, z2) of a node table with the residual r0,
    r1, r2, the diagonal d0, d1, d2 and the fixed values g0, g1, g2 (null where free);
    it has to be symmetric. Without one, the diagonal is the preconditioner.

    Stops when the largest residual falls to ``tolerance`` times the first one, and
    raises if a search direction has no positive energy. Vectors are columns of one
    table, so a step costs one product, two sums and no join between vectors.
    """
    cells = checkpoint(cells.select(*KEY, scale))
    pins = fixed.groupBy(*KEY).agg(*(F.max(F.when(F.col("axis") == a, F.col("value"))).alias(f"g{a}") for a in range(3)))
    n = nodes_of(cells).join(pins, KEY, "left").join(forces.select(*KEY, "fx", "fy", "fz"), KEY, "left").join(diagonal(cells, mu, lam, dx, scale), KEY)
    n = checkpoint(n.select(*KEY, *_columns("g"), *_columns("d"), *(F.coalesce(f"f{c}", F.lit(0.0)).alias(f"b{a}") for a, c in enumerate("xyz")), *(F.coalesce(f"g{a}", F.lit(0.0)).alias(f"u{a}") for a in range(3))))
    free = lambda a, v: F.when(F.col(f"g{a}").isNull(), v).otherwise(0.0)
    start = n.join(multiply(cells, n, mu, lam, dx, scale), KEY, "left")
    r = {f"r{a}": free(a, F.col(f"b{a}") - F.coalesce(f"f{a}", F.lit(0.0))) for a in range(3)}
    n = checkpoint(start.select(*n.columns, *(c.alias(k) for k, c in r.items()), *(F.lit(0.0).alias(f"x{a}") for a in range(3)), *(F.lit(0.0).alias(f"s{a}") for a in range(3))))
    top = F.max(F.greatest(*(F.abs(f"r{a}") for a in range(3)))).alias("top")

    def z(a: int) -> Column:
        return F.col(f"z{a}") if precondition else F.when(F.col(f"d{a}") != 0, F.col(f"r{a}") / F.col(f"d{a}")).otherwise(0.0)

    def conditioned(df: DataFrame) -> DataFrame:
        return checkpoint(df.drop(*_columns("z")).join(precondition(df), KEY)) if precondition else df

    n = conditioned(n)
    rho = F.sum(sum((F.col(f"r{a}") * z(a) for a in range(1, 3)), F.col("r0") * z(0))).alias("rho")
    first = before = None
    out = Solution(n)
    for step in range(max_iterations + 1):
        now = n.agg(top, rho).first()
        out.residuals.append(now["top"] or 0.0)
        first = out.residuals[0]
        if out.residuals[-1] <= tolerance * first or step == max_iterations:
            out.success = out.residuals[-1] <= tolerance * first
            break
        beta = now["rho"] / before if before else 0.0
        before = now["rho"]
        n = n.withColumns({f"s{a}": F.lit(beta) * F.col(f"s{a}") + z(a) for a in range(3)})
        q = multiply(cells, n, mu, lam, dx, scale, _columns("s"))
        n = checkpoint(n.join(q, KEY, "left").withColumns({f"f{a}": free(a, F.coalesce(f"f{a}", F.lit(0.0))) for a in range(3)}))
        energy = n.agg(F.sum(sum((F.col(f"s{a}") * F.col(f"f{a}") for a in range(1, 3)), F.col("s0") * F.col("f0")))).first()[0]
        if energy <= 0:
            raise ValueError("the system isn't positive definite: is a component without support?")
        alpha = F.lit(before / energy)
        n = n.withColumns({f"x{a}": F.col(f"x{a}") + alpha * F.col(f"s{a}") for a in range(3)} | {f"r{a}": F.col(f"r{a}") - alpha * F.col(f"f{a}") for a in range(3)}).drop(*_columns("f"))
        n = conditioned(n)
    out.nodes = n.select(*KEY, *((F.col(f"u{a}") + F.col(f"x{a}")).alias(u) for a, u in enumerate(U)))
    return out
