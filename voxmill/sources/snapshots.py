"""Snapshots of a state as a folder of Parquet tables, and iterations in partitions of one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.functions.grid import BLOCK, BLOCK_KEY, KEY, with_block
from voxmill.operators.band import fat, thin
from voxmill.session import checkpoint


def save_state(path: str, tables: dict[str, DataFrame], iteration: int, compact: bool = False, scope: DataFrame | None = None) -> None:
    """Writes each table, of ``cells`` only density and flags if compact, and only those in the blocks ``scope`` if given (thin ones, say), and last of all the iteration."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if scope is not None and name == "cells":
            df = with_block(df).join(scope.select(*BLOCK_KEY).distinct(), BLOCK_KEY, "left_semi").drop(*BLOCK_KEY)
        if compact and name == "cells":
            df = df.select(*KEY, *(c for c in ("flags", "density") if c in df.columns))
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(iteration, sorted(tables))], "iteration int, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/state")


def load_state(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], int]:
    """The tables and the last iteration."""
    state = spark.read.schema("iteration int, tables array<string>").json(f"{path}/state").first()
    return {name: spark.read.parquet(f"{path}/{name}") for name in state["tables"]}, state["iteration"]


def append_iteration(path: str, df: DataFrame, iteration: int) -> None:
    """One partition of the series of problems or densities; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/iter={iteration}")


def load_density(container: DataFrame, stored: DataFrame, penalty: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(cells, dropped): stored densities inside the container, clamped to [0, 1], and those outside of it.

    With a penalty of 0 the stored values are stiffnesses, whose cube root is the density.
    """
    value = F.col("density") if penalty else F.cbrt("density")
    d = stored.where("density <> 0").select(*KEY, F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("density"))
    keys = container.select(*KEY).distinct()
    return d.join(keys, KEY, "left_semi"), d.join(keys, KEY, "left_anti")


def load_density_with_bands(container: DataFrame, stored: DataFrame, penalty: float = 3.0, minimum: float = 0.0, threshold: float = 1e-6) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cells, thin, fat, dropped): the whole container with the stored densities, 0 where none is, and both bands of blocks made anew."""
    kept, dropped = load_density(container, stored, penalty)
    rest = container.drop("density")
    cells = checkpoint(rest.join(kept, KEY, "left").withColumn("density", F.coalesce("density", F.lit(0.0))))
    thin_blocks = thin(cells, minimum, threshold)
    return cells, thin_blocks, fat(cells, thin_blocks, with_block(cells).select(*BLOCK_KEY).distinct(), threshold=threshold), dropped


def as_text(df: DataFrame, path: str) -> None:
    """A readable dump: a JSON object a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def record_iteration(path: str, name: str, df: DataFrame, iteration: int, counts: dict[str, Column], values: dict[str, float] | None = None) -> dict:
    """Writes a table's partition of an iteration and a row of the iteration table: ``values``, and aggregates gathered while the table is written.

    Writing an iteration again replaces it; the row is written last, so it stands for a whole partition.
    """
    seen = Observation()
    append_iteration(f"{path}/{name}", df.observe(seen, *(c.alias(k) for k, c in counts.items())), iteration)
    row = (values or {}) | seen.get
    spark = df.sparkSession
    kinds = ", ".join(f"`{k}` {'long' if isinstance(v, int) else 'double'}" for k, v in row.items())
    append_iteration(f"{path}/iterations", spark.createDataFrame([tuple(row.values())], kinds).coalesce(1), iteration)
    return row


def iterations(spark: SparkSession, path: str) -> DataFrame:
    """The iteration table: a row for each iteration with its number ``iter``."""
    return spark.read.parquet(f"{path}/iterations")


def convergence(table: DataFrame, least: float = 5e-3, after: int = 10) -> DataFrame:
    """(iter, ratio, converged): how much the last two objectives differ from the two before; null for the first three."""
    w = Window.orderBy("iter")  # a row for each iteration
    o = [F.lag("objective", n).over(w) if n else F.col("objective") for n in range(4)]
    ratio = F.abs((o[0] + o[1] - o[2] - o[3]) / (o[0] + o[1]))
    found = table.select("iter", ratio.alias("ratio"), F.row_number().over(w).alias("n"))
    return found.select("iter", "ratio", F.coalesce((F.col("n") >= after) & (F.col("ratio") < least), F.lit(False)).alias("converged"))


def _newest(spark: SparkSession, path: str, iteration: int | None) -> DataFrame:
    """(bi, bj, bk, iter, digest): the newest version of each block up to an iteration; without a digest it is gone."""
    seen = spark.read.parquet(f"{path}/digests")
    seen = seen if iteration is None else seen.where(F.col("iter") <= iteration)
    return seen.groupBy(*BLOCK_KEY).agg(F.max(F.struct("iter", "digest")).alias("v")).select(*BLOCK_KEY, "v.*")


def save_blocks(path: str, cells: DataFrame, iteration: int, first: bool = False, size: tuple[int, int, int] = BLOCK) -> None:
    """Stores the blocks of cells that have changed since the iterations saved before, and which ones are gone.

    ``first`` begins the series. Digests of blocks tell what has changed; they are
    written last, and cells of an iteration without digests are never read.
    """
    spark = cells.sparkSession
    own = with_block(cells, size)
    digest = F.concat_ws("/", F.count("*"), F.expr("bit_xor(_h)"))
    now = own.withColumn("_h", F.xxhash64(*sorted(cells.columns))).groupBy(*BLOCK_KEY).agg(digest.alias("now"))
    if first:
        changed = now.withColumnRenamed("now", "digest")
    else:
        known = _newest(spark, path, iteration - 1).where("digest is not null")
        both = now.join(known, BLOCK_KEY, "full").where(~F.col("now").eqNullSafe(F.col("digest")))
        changed = both.select(*BLOCK_KEY, F.col("now").alias("digest"))
    changed = checkpoint(changed)
    append_iteration(f"{path}/cells", own.join(changed, BLOCK_KEY, "left_semi"), iteration)
    append_iteration(f"{path}/digests", changed, iteration)


def load_blocks(spark: SparkSession, path: str, iteration: int | None = None) -> DataFrame:
    """The cells of all blocks as the newest iterations up to one have them."""
    newest = _newest(spark, path, iteration).where("digest is not null").drop("digest")
    return spark.read.parquet(f"{path}/cells").join(newest, [*BLOCK_KEY, "iter"], "left_semi").drop(*BLOCK_KEY, "iter")


def curve_key(block: int = 8) -> Column:
    """A block's place on a space-filling curve: the bits of its three numbers in turn, 20 of each."""
    spread = lambda c: sum((F.shiftleft(F.shiftright(c, n).bitwiseAND(F.lit(1)), 3 * n) for n in range(1, 20)), c.bitwiseAND(F.lit(1)))
    at = [F.floor(F.col(c) / block).cast("long") + (1 << 19) for c in KEY]
    return spread(at[0]) + F.shiftleft(spread(at[1]), 1) + F.shiftleft(spread(at[2]), 2)


def save_clustered(cells: DataFrame, path: str, group_bytes: int = 16 << 20, block: int = 8) -> None:
    """Cells in the order of a space-filling curve of their blocks, so that each row group of the files covers a small box.

    What a slab, a slice or a threshold in a region asks for then skips row groups by their statistics.
    """
    key = cells.withColumn("_key", curve_key(block=block))
    ordered = key.repartitionByRange("_key").sortWithinPartitions("_key", *KEY).drop("_key")
    ordered.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)


def in_slab(cells: DataFrame, axis: str, low: int, high: int, least: float | None = None) -> DataFrame:
    """The cells whose index on an axis (x, y or z) is in the half-open range, with a density of ``least`` at least."""
    c = F.col(KEY["xyz".index(axis)])
    found = cells.where((c >= low) & (c < high))
    return found if least is None else found.where(F.col("density") >= least)


def slab(spark: SparkSession, path: str, axis: str, low: int, high: int, least: float | None = None) -> DataFrame:
    """``in_slab`` of stored cells."""
    return in_slab(spark.read.parquet(path), axis, low, high, least)
