"""Query registry: name -> Spark callable, and its oracle text where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand_rounding(text: str) -> str:
    """Expands ``q_N(expr)`` in an oracle text to the rounding both engines share (see ``q``)."""
    while m := re.search(r"\bq_(\d+)\(", text):
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        unit = f"1e{m.group(1)}"
        text = text[: m.start()] + f"(cast(floor(({text[m.end() : i - 1]}) * {unit} + 0.537) as double) / {unit})" + text[i:]
    return text


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = expand_rounding(sql)
        return fn

    return add


def q(c: Column | str, digits: int) -> Column:
    """Rounding with the tie point off any short decimal, so engines cannot differ on ties."""
    col = F.col(c) if isinstance(c, str) else c
    unit = float(f"1e{digits}")
    return F.floor(col * F.lit(unit) + 0.537).cast("double") / F.lit(unit)


def rounded(df: DataFrame, digits: int, only: list[str] | None = None) -> DataFrame:
    """All double columns (or ``only``) rounded."""
    names = only or [c for c, t in df.dtypes if t == "double"]
    return df.select(*[q(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])
