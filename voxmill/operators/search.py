"""Thresholds and multipliers from counted and summed ranges, and places in a whole order."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.session import checkpoint


def ranked(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """The rows with their place, from 0, in the order of all of them.

    Sorted by ranges; each range begins after the counted rows of those before it, so
    no task and no driver sees more than its own range.
    """
    at, mask = F.col("_at"), F.lit((1 << 33) - 1)
    placed = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted(placed.groupBy(F.shiftright(at, 33).alias("p")).count().collect())  # a row for each range
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    own = placed.withColumn("_part", F.shiftright(at, 33)).join(F.broadcast(starts), "_part")
    return own.withColumn(name, F.col("_before") + at.bitwiseAND(mask)).drop("_part", "_before", "_at")


def threshold_for_volume(cells: DataFrame, target: float, value: str = "density", tolerance: float = 1e-8) -> float:
    """The least threshold of a grid from 0 to 1, no coarser than the tolerance, that leaves at most ``target`` cells.

    Two counts by grid place: of the upper half of its bits, then of the lower half where the target is passed.
    """
    bits = ceil(log2(1 / tolerance))
    low, top = bits - bits // 2, 1 << bits
    keys = cells.select(F.least(F.floor(F.col(value) * float(top)), F.lit(top)).alias("k")).where("k > 0")
    above, answer = 0, 0
    for shift in (low, 0):
        part = keys if shift else keys.where(F.shiftright("k", low) == answer)
        counts = part.groupBy(F.shiftright("k", shift).alias("b")).count().collect()  # a row for each place: 2^14 or so at most
        for b, n in sorted(counts, reverse=True):
            if above + n > target:
                answer = b
                break
            above += n
        else:
            return 1 / top
    return min((answer + 1) / top, 1.0)


def rising_root(df: DataFrame, slope: Column, low: Column, high: Column, target: float, start: float, stop: float, places: int = 4096) -> float:
    """The t from start to stop at which the sum of slope * t, held between low and high in each row, reaches the target.

    A row's part is constant, rises between two values of t and is constant again.
    These values are summed by ranges of t, so the sum is known at the ranges' ends;
    the range that the target lies in is cut again twice, which leaves a straight piece.
    """
    rises = F.when(slope > 0, slope)
    event = lambda t, k, s: F.struct(t.cast("double").alias("t"), k.cast("double").alias("k"), s.cast("double").alias("s"))
    events = F.array(event(F.lit(0.0), low, F.lit(0.0)), event(low / rises, -low, rises), event(high / rises, high, -rises))
    events = df.select(F.explode(events).alias("e")).select("e.*").where("t is not null and k is not null")
    k, s, ends = 0.0, 0.0, None
    for cut in range(3):
        if ends is None:
            many = ceil(log2(stop / start) * 64)
            ends = [start * (stop / start) ** (n / many) for n in range(many + 1)]
            place = F.when(F.col("t") <= start, -1).otherwise(F.floor(F.log2(F.col("t") / start) * (many / log2(stop / start))))
        else:
            a, b = ends
            many = places
            ends = [a + (b - a) * n / many for n in range(many + 1)]
            place = F.floor((F.col("t") - a) / (b - a) * many)
            events = events.where((F.col("t") >= a) & (F.col("t") < b))
        sums = events.groupBy(F.least(place, F.lit(many)).alias("n")).agg(F.sum("k"), F.sum("s")).collect()  # a row for each range
        found = {n: (x, y) for n, x, y in sums}
        k, s = (x + y for x, y in zip((k, s), found.get(-1, (0.0, 0.0)) if cut == 0 else (0.0, 0.0), strict=True))
        if cut == 0 and k + s * start >= target:
            return start
        for n in range(many):
            x, y = found.get(n, (0.0, 0.0))
            if k + x + (s + y) * ends[n + 1] >= target:
                break
            k, s = k + x, s + y
        else:
            if cut == 0:
                return stop
        below, above = k + s * ends[n], k + x + (s + y) * ends[n + 1]
        ends = [ends[n], ends[n + 1]]
    a, b = ends
    return a + (b - a) * (target - below) / (above - below) if above > below else b


def cut(cells: DataFrame, threshold: float, value: str = "density", fixed: Column | None = None) -> DataFrame:
    """Values at or over the threshold, and those of fixed cells, become 1, others 0."""
    full = F.col(value) >= threshold if fixed is None else (F.col(value) >= threshold) | fixed
    return cells.withColumn(value, F.when(full, 1.0).otherwise(0.0))
