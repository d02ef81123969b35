"""What both vector searches share: the rows that take part, and bounded blocks of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(e: Column) -> Column:
    """The vector isn't null or empty and has no null or non-finite component."""
    d = e.cast("array<double>")
    good = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & good, F.lit(False))


def taking_part(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, e) of the rows that take part. Equal rows count once; rows without an id take no part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e"))
    return v.where(F.col("vec_id").isNotNull() & finite(F.col("e"))).dropDuplicates()


def stack(column: pd.Series, dtype: type = np.float64) -> np.ndarray:
    """The vectors of one dimension as the rows of a matrix."""
    return np.stack([np.asarray(x, dtype=dtype) for x in column]) if len(column) else np.zeros((0, 0), dtype)
