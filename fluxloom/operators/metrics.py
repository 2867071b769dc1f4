"""Evaluation tables for classifiers and survival scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluxloom.plans.ordering import running_index, running_sums
from fluxloom.session import durable


def _by_class(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """Long form: class_name, hit (0/1), p."""
    return (
        df.select(F.col(truth).cast("string").alias("_y"), *[F.col(c).alias(n) for n, c in probabilities.items()])
        .unpivot(["_y"], list(probabilities), "class_name", "p")
        .select("class_name", (F.col("_y") == F.col("class_name")).cast("int").alias("hit"), "p")
    )


def _with_macro(per_class: DataFrame, value: str) -> DataFrame:
    macro = per_class.agg(F.avg(value).alias(value)).select(F.lit("macro_avg").alias("class_name"), value)
    return per_class.unionByName(macro)


def brier(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """Mean squared error of each class probability, and their mean."""
    long = _by_class(df, truth, probabilities)
    return _with_macro(long.groupBy("class_name").agg(F.avg(F.pow(F.col("p") - F.col("hit"), 2)).alias("brier")), "brier")


def roc_auc(df: DataFrame, truth: str, probabilities: dict[str, str]) -> DataFrame:
    """Area under the one-vs-rest curve per class; null where a class is absent or alone.

    Scores are counted first, then ranked by one global prefix sum; ties count half.
    """
    long = _by_class(df, truth, probabilities).where("p is not null")
    counted = long.groupBy("class_name", "p").agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    placed = running_sums(counted, ["p"], {"neg_upto": F.col("neg")}, ["class_name"])
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    total = F.sum("pos") * F.sum("neg")
    return _with_macro(placed.groupBy("class_name").agg(F.when(total > 0, wins / total).alias("auc")), "auc")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, f1, support per class; accuracy, macro and weighted means."""
    cells = durable(confusion(df, truth, predicted))  # classes squared rows
    right = F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0))
    actual = cells.groupBy(F.col("truth").alias("class_name")).agg(F.sum("n").alias("support"), right.alias("hits"))
    called = cells.groupBy(F.col("predicted").alias("class_name")).agg(F.sum("n").alias("called"))
    z = lambda c: F.coalesce(c, F.lit(0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    per = actual.join(called, "class_name", "full_outer").select(
        "class_name", z("support").alias("support"), z("hits").alias("hits"), z("called").alias("called")
    )
    per = per.withColumn("precision", ratio(F.col("hits"), F.col("called"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    per = per.withColumn("f1", f1).select("class_name", "precision", "recall", "f1", "support", "hits")
    figures = ("precision", "recall", "f1")
    n = F.sum("support").alias("support")
    macro = per.agg(*[F.avg(c).alias(c) for c in figures], n).withColumn("class_name", F.lit("macro avg"))
    weighted = per.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in figures], n).withColumn("class_name", F.lit("weighted avg"))
    acc = per.agg((F.sum("hits") / F.sum("support")).alias("f1"), n).select(
        F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), "f1", "support", F.lit("accuracy").alias("class_name")
    )
    return per.drop("hits").unionByName(macro).unionByName(weighted).unionByName(acc)


def reliability(df: DataFrame, truth: str, probabilities: dict[str, str], bins: int = 10) -> DataFrame:
    """Mean predicted and observed share per uniform probability bin; empty bins are left out."""
    slot = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return (
        _by_class(df, truth, probabilities)
        .groupBy("class_name", slot.alias("bin"))
        .agg(F.avg("p").alias("mean_predicted"), F.avg("hit").alias("positive_rate"), F.count("*").alias("n"))
    )


# --- concordance --------------------------------------------------------------------------

_RADIX = 4


def concordance(df: DataFrame, duration: str = "duration", event: str = "event", score: str = "score") -> DataFrame:
    """Concordance of a risk score (higher = sooner) with censored durations, one row.

    A pair counts when the shorter duration had the event; of equal durations, when exactly one
    had it. Equal scores count half. Pairs are not made: scores become ranks, and two rows
    with different ranks first differ at one digit. Per digit level, rows with the same
    higher digits form a group, and prefix sums over durations count how many later rows
    have a smaller digit. That is exact with log(ranks) rows per distinct row.
    """
    base = df.where(F.col(duration).isNotNull() & F.col(event).isNotNull() & F.col(score).isNotNull()).groupBy(
        F.col(duration).cast("double").alias("d"), F.col(event).cast("int").alias("e"), F.col(score).cast("double").alias("s")
    ).agg(F.count("*").alias("n"))
    ranks = running_index(base.select("s").distinct(), ["s"], name="r")
    rows = durable(base.join(ranks, "s").select("d", "e", "n", "r"))
    top = rows.agg(F.max("r")).first()[0] or 0
    levels = max(1, math.ceil(math.log(top + 1, _RADIX) + 1e-9)) if top else 1

    def later(frame: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
        """Adds ``<name>_after``: total of strictly longer durations inside each key."""
        placed = running_sums(frame.withColumn("_minus_d", -F.col("d")), ["_minus_d"], sums, keys)
        for name, own in sums.items():
            placed = placed.withColumn(f"{name}_after", F.col(name) - own)
        return placed

    # every usable pair, whatever the scores
    per_d = rows.groupBy("d").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("e") == 1, F.col("n")).otherwise(0)).alias("ev"))
    pairs = later(per_d, [], {"cum": F.col("all")})
    usable = pairs.agg(F.coalesce(F.sum(F.col("ev") * (F.col("cum_after") + F.col("all") - F.col("ev"))), F.lit(0)).alias("pairs"))

    # pairs of equal score
    per_r = rows.groupBy("r", "d").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("e") == 1, F.col("n")).otherwise(0)).alias("ev"))
    same = later(per_r, ["r"], {"cum": F.col("all")})
    ties = same.agg(F.coalesce(F.sum(F.col("ev") * (F.col("cum_after") + F.col("all") - F.col("ev"))), F.lit(0)).alias("ties"))

    # pairs where the sooner row has the higher score
    step = rows.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    unit = F.pow(F.lit(float(_RADIX)), F.col("level")).cast("bigint")
    lower = F.call_function("div", F.col("r"), unit)
    step = step.withColumn("digit", F.pmod(lower, F.lit(_RADIX))).withColumn("group", F.call_function("div", lower, F.lit(_RADIX)))
    cell = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    wide = step.groupBy("level", "group", "d").agg(
        *[cell(F.col("digit") == k).alias(f"all{k}") for k in range(_RADIX)],
        *[cell((F.col("digit") == k) & (F.col("e") == 1)).alias(f"ev{k}") for k in range(_RADIX)],
    )
    sums = {f"cum{k}": F.col(f"all{k}") for k in range(_RADIX - 1)}
    placed = later(wide, ["level", "group"], sums)
    won = F.lit(0)
    for k in range(1, _RADIX):
        for j in range(k):
            won = won + F.col(f"ev{k}") * (F.col(f"cum{j}_after") + F.col(f"all{j}") - F.col(f"ev{j}"))
    wins = placed.agg(F.coalesce(F.sum(won), F.lit(0)).alias("concordant"))
    one = F.lit(True)  # three one-row tables
    out = usable.join(ties, one).join(wins, one)
    return out.select(
        "pairs", "concordant", "ties", F.try_divide(F.col("concordant") + F.col("ties") / 2, F.col("pairs")).alias("c_index")
    )
