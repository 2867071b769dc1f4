"""What counts as missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def nan_as_null(df: DataFrame, columns: Sequence[str] = ("flux_short", "flux_long")) -> DataFrame:
    """NaN is a missing value, like null, in those of ``columns`` that hold floating-point numbers."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns if types.get(c) in ("double", "float")})
