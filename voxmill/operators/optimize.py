"""The density update by optimality criteria, continuation schedules and the outer iteration."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import FIXED_DENSITY, KEY, clamp, has
from voxmill.operators.elasticity import compliance, lame, stiffness
from voxmill.operators.krylov import solve
from voxmill.operators.search import rising_root
from voxmill.operators.stencil import smooth
from voxmill.session import checkpoint


@dataclass(frozen=True)
class Settings:
    """Names and defaults of an optimisation; unknown names are rejected by the constructor."""

    volume_fraction: float = 0.1
    minimum_density: float = 0.0
    minimum_stiffness: float = 1e-9
    youngs: float = 1e6
    poisson: float = 0.3
    fixed_cell_density: float = 1.0
    filter_size: float = 1.5
    penalty: float = 3.0
    progressive_penalty: float = 0.0
    progressive_penalty_step: float = 1.0
    progressive_vol_frac: float = 0.0
    step_limit: float = 0.2
    smart_oc: bool = False
    cg_tolerance: float = 1e-4
    cg_max_iterations: int = 50

    def __post_init__(self) -> None:
        if self.progressive_penalty and self.minimum_stiffness:
            raise ValueError("a progressive penalty needs a minimum stiffness of 0")
        if not self.minimum_stiffness and not self.minimum_density:
            raise ValueError("minimum stiffness and minimum density can't both be 0")
        if self.volume_fraction <= self.minimum_density:
            raise ValueError("the volume fraction must exceed the minimum density")

    def override(self, **changes) -> Settings:
        return replace(self, **changes)


def volume_fraction(s: Settings, iteration: int) -> float:
    share = min(iteration / s.progressive_vol_frac, 1.0) if s.progressive_vol_frac else 1.0
    return 1.0 + share * (s.volume_fraction - 1.0)


def penalty(s: Settings, iteration: int) -> float:
    share = min(iteration / s.progressive_penalty_step / s.progressive_penalty, 1.0) if s.progressive_penalty else 1.0
    return 1.0 + share * (s.penalty - 1.0)


def updated(density: Column, gradient: Column, multiplier: Column, step: float = 0.2, minimum: float = 0.0, shift: float = 0.0) -> Column:
    """The new density for one multiplier."""
    raw = density * F.sqrt(F.greatest(F.lit(0.0), -gradient - F.least(F.lit(0.0), F.lit(shift))) / multiplier)
    return clamp(clamp(raw, density - step, density + step), minimum, 1.0)


def gradient_range(cells: DataFrame, smart_oc: bool = False) -> DataFrame:
    """One row: fixed cells, all cells, and least and largest negative gradient; without smart_oc both are neutral."""
    fixed = has(F.col("flags"), FIXED_DENSITY)
    free = F.when(~fixed, -F.col("dc0"))
    least, most = (F.min(free), F.max(free)) if smart_oc else (F.lit(1e30), F.lit(-1e30))
    return cells.agg(F.count_if(fixed).alias("fixed"), F.count("*").alias("cells"), least.alias("neg_dc_min"), most.alias("neg_dc_max"))


def oc_step(cells: DataFrame, target: float, s: Settings | None = None, shift: float = 0.0) -> tuple[DataFrame, float]:
    """The cells with their densities updated to the volume ``target``, and the multiplier.

    Cells with FIXED_DENSITY in ``flags`` take the fixed density and no part in the volume.
    """
    s = s or Settings()
    fixed = has(F.col("flags"), FIXED_DENSITY) if "flags" in cells.columns else F.lit(False)
    d = F.col("density")
    bound = lambda x: clamp(x, s.minimum_density, 1.0)
    rise = d * F.sqrt(F.greatest(F.lit(0.0), -F.col("dc0") - min(0.0, shift)))  # of a density with 1 / sqrt(multiplier)
    root = rising_root(cells.where(~fixed), rise, bound(d - s.step_limit), bound(d + s.step_limit), target, 1e-10, 1e10)
    multiplier = 1 / root**2
    new = updated(d, F.col("dc0"), F.lit(multiplier), s.step_limit, s.minimum_density, shift)
    return cells.withColumn("density", F.when(fixed, s.fixed_cell_density).otherwise(new)), multiplier


def iterate(cells: DataFrame, forces: DataFrame, fixed: DataFrame, dx: float, iteration: int, s: Settings) -> tuple[DataFrame, dict]:
    """One outer iteration on cells (i, j, k, density): solve, gradient, smoothing, density update."""
    mu, lam = lame(s.youngs, s.poisson)
    p = penalty(s, iteration)
    work = cells.withColumn("scale", stiffness(F.col("density"), p, s.minimum_stiffness))
    solution = solve(work, forces, fixed, mu, lam, dx, s.cg_tolerance, s.cg_max_iterations)
    c = checkpoint(compliance(cells, solution.nodes, mu, lam, p, s.minimum_stiffness))
    objective = c.agg(F.sum("part")).first()[0]
    smoothed = smooth(c, s.filter_size).drop("dc1")
    ready = checkpoint(cells.join(smoothed, KEY))
    new, multiplier = oc_step(ready, volume_fraction(s, iteration) * ready.count(), s)
    log = {"iter": iteration, "objective": objective, "multiplier": multiplier, "residual": solution.residuals[-1], "cg_steps": len(solution.residuals) - 1}
    return checkpoint(new.drop("dc0")), log


def converged(objectives: list[float], least: float = 5e-3, after: int = 10) -> bool:
    """The last two objectives differ little from the two before."""
    if len(objectives) < max(4, after):
        return False
    o1, o2, o3, o4 = objectives[:-5:-1]
    return abs((o1 + o2 - o3 - o4) / (o1 + o2)) < least


def run(cells: DataFrame, forces: DataFrame, fixed: DataFrame, dx: float, iterations: int, settings: Settings | None = None, stop_early: bool = False) -> tuple[DataFrame, list[dict]]:
    """The optimisation loop; the log has a row for each iteration."""
    s, log = settings or Settings(), []
    for n in range(iterations):
        cells, entry = iterate(cells, forces, fixed, dx, n, s)
        log.append(entry)
        if stop_early and converged([e["objective"] for e in log]):
            break
    return cells, log
