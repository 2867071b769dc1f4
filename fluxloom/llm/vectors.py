"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: str) -> Column:
    """True for vectors that are not null, not empty, not zero and hold only finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_width(df: DataFrame, vector: str) -> int:
    """The most frequent number of components (the smaller of equally frequent ones), 0 without rows."""
    row = df.groupBy(F.size(vector).alias("w")).count().orderBy(F.desc("count"), "w").first()
    return int(row["w"]) if row else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of equal widths, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width)
