"""Connected components of cells and blocks, and the filter that keeps the one large component."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.grid import BLOCK, BLOCK_KEY, KEY, with_block
from voxmill.operators.band import fat, thin
from voxmill.operators.graph import connected_components
from voxmill.session import checkpoint

def packed(i: Column, j: Column, k: Column) -> Column:
    """A key as one long, in the keys' order; stops at coordinates outside of 20 bits and a sign."""
    half = 1 << 20
    far = F.greatest(*(F.abs(c.cast("long") + F.lit(0.5)) for c in (i, j, k))) > half
    return F.when(far, F.raise_error(F.lit("a coordinate doesn't fit into 21 bits")).cast("long")).otherwise(((i.cast("long") + half) * (2 * half) + (j + half)) * (2 * half) + (k + half))


def _side(axis: int, at: int) -> int:
    """The bits of a block's cells with the coordinate ``at`` on an axis; bit 16i + 4j + k is the cell i, j, k."""
    return sum(1 << n for n, p in enumerate(product(range(4), repeat=3)) if p[axis] == at)


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


STEPS = (16, 4, 1)  # from a cell's bit to its next neighbour's on each axis


def parts(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bits) of every face-connected part of each mask of 64 cells, all rows at a time."""
    rows, left, found = np.flatnonzero(masks), masks.copy(), []
    inner = [(np.uint64(step), ~np.uint64(_side(axis, 3)), ~np.uint64(_side(axis, 0))) for axis, step in enumerate(STEPS)]
    while len(rows):
        own, part = masks[rows], left[rows] & (~left[rows] + np.uint64(1))  # from the least cell left
        while True:
            grown = part.copy()
            for step, low, high in inner:
                grown |= ((part & low) << step) | ((part & high) >> step)
            grown &= own
            if (grown == part).all():
                break
            part = grown
        found.append((rows, part))
        left[rows] &= ~part
        rows = rows[left[rows] != 0]
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return tuple(np.concatenate(x) for x in zip(none, *found, strict=True))


def block_parts(cells: DataFrame) -> DataFrame:
    """(bi, bj, bk, bits, id): the parts of each 4^3 block; a part is named by the packed key of its least cell."""
    local = F.pmod("i", F.lit(4)) * 16 + F.pmod("j", F.lit(4)) * 4 + F.pmod("k", F.lit(4))
    bit = F.when(packed(*(F.col(c) for c in KEY)).isNotNull(), F.expr("shiftleft(1L, _at)"))
    masks = with_block(cells.select(*KEY)).withColumn("_at", local.cast("int")).groupBy(*BLOCK_KEY).agg(F.bit_or(bit).alias("mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bits = parts(batch.column(3).to_numpy().view(np.uint64))
            order = np.argsort(rows, kind="stable")
            least = np.log2((bits & (~bits + np.uint64(1))).astype(np.float64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(rows[order])) for n in range(3)), pa.array(bits[order].view(np.int64)), pa.array(least[order])], names=[*BLOCK_KEY, "bits", "least"])

    found = masks.mapInArrow(run, "bi int, bj int, bk int, bits long, least int")
    at = [(F.col(b) * 4 + F.expr(f"least div {step}") % 4).cast("int") for b, step in zip(BLOCK_KEY, STEPS, strict=True)]
    return found.select(*BLOCK_KEY, "bits", packed(*at).alias("id"))


def face_components(cells: DataFrame) -> DataFrame:
    """(i, j, k, component): 6-connected components, named by the packed key of their least cell.

    Two levels: the parts of each block, from one aggregation of the cells, and the
    components of the graph of parts that meet at a face of two blocks.
    """
    found = checkpoint(block_parts(cells))
    far = [F.shiftrightunsigned(F.col("bits").bitwiseAND(F.lit(_signed(_side(a, 3)))), 3 * step) for a, step in enumerate(STEPS)]
    sent = F.array(*(F.struct(*(F.lit(int(a == n)).alias(c) for n, c in enumerate("xyz")), bits.alias("bits")) for a, bits in enumerate(far)))
    sent = found.select("id", *BLOCK_KEY, F.explode(F.filter(sent, lambda s: s["bits"] != 0)).alias("to"))
    sent = sent.select(F.col("id").alias("src"), F.col("to.bits").alias("reached"), *((F.col(b) + F.col(f"to.{c}")).alias(b) for b, c in zip(BLOCK_KEY, "xyz", strict=True)))
    edges = sent.join(found, BLOCK_KEY).where(F.col("bits").bitwiseAND(F.col("reached")) != 0).select("src", F.col("id").alias("dst"))
    named = found.join(connected_components(edges), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    cell = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda n: F.getbit("bits", n) == 1)).alias("n")
    own = named.select(*BLOCK_KEY, "component", cell)
    return own.select(*((F.col(b) * 4 + F.expr(f"n div {step}") % 4).cast("int").alias(c) for b, c, step in zip(BLOCK_KEY, KEY, STEPS, strict=True)), "component")


def sizes(components: DataFrame) -> DataFrame:
    """(component, cells, fraction)."""
    n = components.groupBy("component").agg(F.count("*").alias("cells"))
    total = n.agg(F.sum("cells").alias("_all"))  # a single row
    return n.join(F.broadcast(total)).select("component", "cells", (F.col("cells") / F.col("_all")).alias("fraction"))


def main_blocks(blocks: DataFrame, least: float = 0.3) -> DataFrame:
    """Of blocks (bi, bj, bk) those of the one component over the share ``least``."""
    keys = blocks.select(*(F.col(b).alias(c) for b, c in zip(BLOCK_KEY, KEY, strict=True)))
    return main_component(keys, least).select(*(F.col(c).alias(b) for b, c in zip(BLOCK_KEY, KEY, strict=True)))


def filter_blocks(cells: DataFrame, minimum: float, size: tuple[int, int, int] = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(cells, thin blocks) of the one main component of thin blocks; the densities of the other blocks are 0."""
    kept = checkpoint(main_blocks(thin(cells, minimum, size=size)))
    on = with_block(cells, size).join(kept.withColumn("_on", F.lit(True)), BLOCK_KEY, "left")
    return on.withColumn("density", F.when(F.col("_on"), F.col("density")).otherwise(0.0)).drop("_on", *BLOCK_KEY), kept


def filter_voxels(cells: DataFrame, threshold: float, minimum: float = 0.0, size: tuple[int, int, int] = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, thin blocks, fat blocks) without what isn't in the one main component.

    Cells over the threshold in thin blocks make the components. All others over it
    leave the container for good; the blocks are made anew from what stays.
    """
    dense = with_block(cells, size).where(F.col("density") > threshold).join(thin(cells, minimum, size=size), BLOCK_KEY, "left_semi")
    kept = checkpoint(main_component(dense))
    gone = cells.where(F.col("density") > threshold).join(kept, KEY, "left_anti").select(*KEY)
    left = checkpoint(cells.join(gone, KEY, "left_anti"))
    thin_blocks = thin(left, minimum, size=size)
    container = with_block(left, size).select(*BLOCK_KEY).distinct()
    return left, thin_blocks, fat(left, thin_blocks, container, size=size)


def filter_density(values: DataFrame, threshold: float) -> DataFrame:
    """All values, 0 where they are under the threshold or outside the one main component."""
    kept = checkpoint(main_component(values.where(F.col("density") > threshold))).withColumn("_on", F.lit(True))
    return values.join(kept, KEY, "left").withColumn("density", F.when(F.col("_on"), F.col("density")).otherwise(0.0)).drop("_on")


def threshold_and_kill(cells: DataFrame, threshold: float, minimum: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells under the threshold leave the container; then filter_voxels."""
    return filter_voxels(cells.where(F.col("density") >= threshold), 0.0, minimum)


def main_component(cells: DataFrame, least: float = 0.3) -> DataFrame:
    """The cells of the one component over the share ``least``; stops unless exactly one is."""
    found = checkpoint(face_components(cells))
    large = sizes(found).where(F.col("fraction") > least).select("component").limit(2).collect()
    if len(large) != 1:
        raise ValueError(f"{'no' if not large else 'more than one'} component holds over {least:.0%} of the cells")
    return found.where(F.col("component") == large[0][0]).select(*KEY)
