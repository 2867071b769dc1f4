"""Exact medians over time ranges by histogram and refinement.

A monotone value bin (under 1 % wide) is counted per cell, so the bins holding the middle
ranks are known without pairing ranges with samples. Bins with few values are then looked at value by value. A bin that holds more than
``DIRECT`` values of a range is split again, into ``SPLIT`` finer bins counted on the same ladder, until few are left or the bin cannot be
split; what is left then is counted per distinct value, on the ladder, too. So no range is paired with more than ``DIRECT`` samples, and a constant
series or one within a fraction of a percent costs as little as any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluxloom.plans.ordering import running_sums
from fluxloom.plans.ranges import Part, range_aggregate, range_join
from fluxloom.session import durable


DIRECT = 64  # values of a range in one bin that are looked at one by one
SPLIT = 256
DEEPEST = 4  # splits; the logarithm of a double has no more digits


def _place(v: Column) -> Column:
    """Order-preserving in |v|: 128 per factor e."""
    return F.log(F.abs(v)) * 128


def value_bin(v: Column) -> Column:
    """Order-preserving bin of a double: 128 bins per factor e, mirrored for negatives."""
    size = (F.floor(_place(v)) + 100_000).cast("int")
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def _split_bin(v: Column, depth: int) -> Column:
    """Bin number within the bin one step coarser; steps by a power of two are exact, so the order is kept."""
    scaled = _place(v) * F.lit(float(SPLIT**depth))
    fine = (F.floor(scaled) - F.floor(scaled / SPLIT) * SPLIT).cast("int")
    return F.when(v == 0, F.lit(0)).when(v > 0, fine).otherwise(-fine)


def _holds(rank: str, start: Column, end: Column) -> Column:
    return (F.col(rank) > start) & (F.col(rank) <= end)


def range_medians(
    ranges: DataFrame,
    samples: DataFrame,
    *,
    keys: Sequence[str] = (),
    group: Sequence[str],
    value: str,
    base: int,
    longest: int,
    name: str = "median",
    direct: int = DIRECT,
) -> DataFrame:
    """Median of ``value`` (nulls skipped) per row of ``ranges``; empty ranges have no row."""
    keys, group = list(keys), list(group)
    own = list(dict.fromkeys([*keys, *group]))
    binned = samples.where(F.col(value).isNotNull()).select(*keys, "us", F.col(value).alias("_v"), value_bin(F.col(value)).alias("bin"))
    spans = ranges.select(*own, "lo", "hi")

    def counted(spans: DataFrame, rows: DataFrame, bins: list[str], by: str) -> DataFrame:
        """(own, bins, by, n): how many samples of each span and its bins lie in each ``by``."""
        both = spans.withColumn("_lo", F.col("lo")).withColumn("_hi", F.col("hi"))
        found = range_aggregate(
            both,
            rows,
            keys=[*keys, *bins],
            group=[c for c in both.columns if c not in ("lo", "hi")] + [by],
            parts=[Part("n", F.lit(1).cast("bigint"), "sum")],
            finals=[F.sum("n").alias("n")],
            base=base,
            longest=longest,
            by=[by],
        )
        return found.withColumnRenamed("_lo", "lo").withColumnRenamed("_hi", "hi")

    hist = counted(spans, binned, [], "bin")
    upto = W.partitionBy(*group).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    ranked = hist.withColumn("_upto", F.sum("n").over(upto)).withColumn("_total", F.sum("n").over(W.partitionBy(*group)))
    ranked = ranked.withColumn("_low", F.expr("(_total + 1) div 2")).withColumn("_high", F.expr("_total div 2 + 1"))
    before = F.col("_upto") - F.col("n")

    def wanted_of(rows: DataFrame, bins: list[str]) -> DataFrame:
        """Bins that hold a middle rank, with how many samples lie before them."""
        kept = rows.where(_holds("_low", before, F.col("_upto")) | _holds("_high", before, F.col("_upto")))
        return durable(kept.select(*own, *bins, before.alias("_before"), "_low", "_high", "n", "lo", "hi"))

    def picked(rows: DataFrame, bins: list[str]) -> DataFrame:
        """(group, _v low, _v high) of ``rows`` (wanted bins with _v and its count _c)."""
        rank = F.col("_before") + F.sum("_c").over(W.partitionBy(*group, *bins).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
        placed = rows.withColumn("_end", rank).withColumn("_start", F.col("_end") - F.col("_c"))
        pick = lambda k, out: F.max(F.when(_holds(k, F.col("_start"), F.col("_end")), F.col("_v"))).alias(out)
        return placed.groupBy(*group).agg(pick("_low", "_a"), pick("_high", "_b"))

    bins, parts = ["bin"], []
    wanted = wanted_of(ranked, bins)
    for depth in range(1, DEEPEST + 2):
        few = wanted.where(F.col("n") <= direct)
        near = range_join(few.drop("n"), binned, keys=[*keys, *bins], width=max(longest // 4, 1))
        parts.append(picked(near.groupBy(*own, *bins, "_before", "_low", "_high", "_v").agg(F.count("*").alias("_c")), bins))
        many = wanted.where(F.col("n") > direct).drop("n")
        if many.isEmpty():
            break
        if depth > DEEPEST:  # equal values, or as good as equal: one row per distinct value
            each = counted(many, binned.withColumn("_w", F.col("_v")), bins, "_w").withColumnRenamed("n", "_c").withColumnRenamed("_w", "_v")
            parts.append(picked(each, bins))
            break
        finer = f"_bin{depth}"
        binned = binned.withColumn(finer, _split_bin(F.col("_v"), depth))
        hist = counted(many, binned, bins, finer)
        upto = W.partitionBy(*group, *bins).orderBy(finer).rowsBetween(W.unboundedPreceding, 0)
        bins = [*bins, finer]
        wanted = wanted_of(hist.withColumn("_upto", F.col("_before") + F.sum("n").over(upto)), bins)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*group).agg(((F.max("_a") + F.max("_b")) / 2).alias(name))


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of whole columns: rows (column_name, probability, value).

    Values are counted before they are ordered, and the order is global, so no task holds a
    column. Nulls are skipped.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "_v")
    counted = long.where("_v is not null").groupBy("column_name", "_v").agg(F.count("*").alias("_c"))
    placed = running_sums(counted, ["_v"], {"_end": F.col("_c")}, ["column_name"])
    sizes = placed.groupBy("column_name").agg(F.max("_end").alias("_n"))
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    wanted = sizes.withColumn("probability", F.explode(probs)).withColumn("_h", (F.col("_n") - 1) * F.col("probability"))
    wanted = wanted.withColumn("_k", F.floor("_h"))
    both = placed.join(wanted, "column_name")  # a few ranks per column
    holds = lambda k: (F.col("_end") > k) & (F.col("_end") - F.col("_c") <= k)
    lower, upper = holds(F.col("_k")), holds(F.least(F.col("_k") + 1, F.col("_n") - 1))
    ends = both.where(lower | upper).groupBy("column_name", "probability", "_h", "_k").agg(
        F.max(F.when(lower, F.col("_v"))).alias("_a"), F.max(F.when(upper, F.col("_v"))).alias("_b")
    )
    return ends.select("column_name", "probability", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_k"))).alias("value"))
