"""Survival models: proportional hazards by distributed Newton steps, boosted times, curves."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxloom.functions.curves import BUCKET_HOURS, beside_hours, bucket_probabilities
from fluxloom.operators.many import Trees, margin_column
from fluxloom.operators.metrics import concordance
from fluxloom.operators.prep import clean_matrix, tail_split, varying_columns
from fluxloom.operators.reports import top_contributions
from fluxloom.plans.ordering import range_chunks, running_sums
from fluxloom.session import durable, scratch

HORIZON = 168
# Columns that never are covariates.
NOT_FEATURES = ("duration", "event", "timestamp", "region_number", "event_time")


def covariate_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if c not in NOT_FEATURES and t in ("double", "float", "int", "bigint", "smallint")]


# --- proportional hazards -----------------------------------------------------------------


@dataclass
class CoxModel:
    """Coefficients on the covariates' own scale, their means, and the baseline by hour."""

    columns: list[str]
    means: list[float]
    beta: list[float]
    # per hour: (hour, time and cumulative hazard of the last duration at or before it, of the next one)
    baseline: list[tuple]
    steps: int = 0
    log_likelihood: float = 0.0
    converged: bool = True

    def _require(self, df: DataFrame) -> None:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")

    def contributions(self) -> dict[str, Column]:
        return {c: F.lit(b) * (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) - F.lit(m)) for c, b, m in zip(self.columns, self.beta, self.means)}

    def hazard(self, df: DataFrame, output: str = "hazard_score") -> DataFrame:
        """Partial hazard exp(sum of beta * (x - mean))."""
        self._require(df)
        return df.withColumn(output, F.exp(sum(self.contributions().values(), F.lit(0.0))))

    def curve(self, df: DataFrame, output: str = "curve", around: Sequence[float] | None = None) -> DataFrame:
        """Hourly survival curve as an array of (t, s): interpolated between the durations seen
        in training, 1 before the first, flat after the last. With ``around``, only its points beside those hours."""
        scored = self.hazard(df, "_risk")
        point = "struct<t:double,a:double,ha:double,b:double,hb:double>"
        wanted = self.baseline if around is None else beside_hours(self.baseline, [r[0] for r in self.baseline], around)
        rows = ",".join("struct(" + ",".join("cast(null as double)" if v is None else f"{v!r}D" for v in r) + ")" for r in wanted)
        steps = F.expr(f"cast(array({rows}) as array<{point}>)")
        risk = F.col("_risk")

        def at(p: Column) -> Column:
            before, after = F.exp(-p["ha"] * risk), F.exp(-p["hb"] * risk)
            return F.when(p["a"].isNull(), 1.0).when(p["b"].isNull(), before).otherwise(
                before + (after - before) * (p["t"] - p["a"]) / (p["b"] - p["a"])
            )

        return scored.withColumn(output, F.transform(steps, lambda p: F.struct(p["t"].alias("t"), at(p).alias("s")))).drop("_risk")

    def save(self, path: str, spark: SparkSession) -> None:
        schema = "columns array<string>, means array<double>, beta array<double>, baseline array<array<double>>"
        spark.createDataFrame([(self.columns, self.means, self.beta, [list(r) for r in self.baseline])], schema).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str, spark: SparkSession) -> CoxModel:
        r = spark.read.parquet(path).first()
        return CoxModel(list(r["columns"]), list(r["means"]), list(r["beta"]), [tuple(x) for x in r["baseline"]])


MAX_OPEN = 20_000  # durations a task adds up before it hands their sums on


def _columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunk, duration, event and covariates (a row each) of a batch."""
    d, e, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("d", "e", "_chunk"))
    return c, d, e.astype(float), batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(len(d), -1)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), pa.float64()), values.shape[1]).cast(pa.list_(pa.float64()))


def _group_sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sums of their rows of ``values``."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return found, np.add.reduceat(values[order], first, axis=0)


def _chunk_sums(beta: np.ndarray):
    """Per chunk of durations: the largest score, and sums of risk and of risk times covariates relative to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            chunk, _, _, z = _columns_of(batch)
            score = z @ beta
            w = np.exp(score - score.max())[:, None]
            found, sums = _group_sums(chunk, np.hstack([w, w * z]))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), score.max())), _lists(sums)], ["_chunk", "top", "sums"])

    return run


def _merge_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    top = rows["top"].max()
    sums = (np.stack(rows["sums"].to_numpy()) * np.exp(rows["top"].to_numpy() - top)[:, None]).sum(axis=0)
    return pd.DataFrame({"_chunk": rows["_chunk"].iloc[:1], "top": [top], "sums": [sums.tolist()]})


def _duration_sums(beta: np.ndarray, top: float):
    """Per duration: deaths, their scores, and sums of (risk, risk * covariates) over all rows and over the deaths.

    A task adds up over its batches, so that a duration shared by most rows leaves it as one row.
    """

    def rows_of(open_sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        keys, sums = open_sums
        return pa.RecordBatch.from_arrays([pa.array(keys["c"], pa.int64()), pa.array(keys["d"]), _lists(sums)], ["_chunk", "d", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            chunk, d, e, z = _columns_of(batch)
            score = z @ beta - top
            w = np.exp(score)[:, None]
            keys = np.empty(len(d), dtype=[("c", "i8"), ("d", "f8")])
            keys["c"], keys["d"] = chunk, d
            part = _group_sums(keys, np.hstack([e[:, None], (e * score)[:, None], w, w * z, e[:, None] * w, e[:, None] * w * z]))
            held = part if held is None else _group_sums(np.concatenate([held[0], part[0]]), np.vstack([held[1], part[1]]))
            if len(held[0]) > MAX_OPEN:
                yield rows_of(held)
                held = None
        if held is not None:
            yield rows_of(held)

    return run


def _tie_sums(deaths: int, risk: float, dying: float, ties: str, block: int = 1_000_000) -> np.ndarray:
    """Sums over the deaths k of one duration, with s = k / deaths and v = risk - s * dying (Breslow: s = 0):
    ln v, 1/v, s/v, 1/v^2, s/v^2, s^2/v^2; in blocks, as any number of rows may die at once."""
    if ties != "efron":
        return deaths * np.array([np.log(risk), 1 / risk, 0.0, 1 / risk**2, 0.0, 0.0])
    out = np.zeros(6)
    for k in range(0, deaths, block):
        s = np.arange(k, min(k + block, deaths)) / deaths
        v = risk - s * dying
        out += [np.log(v).sum(), (1 / v).sum(), (s / v).sum(), (1 / v**2).sum(), (s / v**2).sum(), (s**2 / v**2).sum()]
    return out


def _chunk_terms(rows: pd.DataFrame, longer: dict[int, np.ndarray], p: int, ties: str) -> pd.DataFrame:
    """The terms of one chunk of durations, given the sums of all longer durations outside it.

    One row per duration (``up``: 1/risk summed over the chunk's deaths up to it, ``own``: what its own deaths take off that)
    and one row without duration for the chunk: log-likelihood, outer products of the mean covariates, and the last ``up``.
    """
    chunk = int(rows["_chunk"].iloc[0])
    d, sums = _group_sums(rows["d"].to_numpy(), np.stack(rows["sums"].to_numpy()))
    deaths, eta = np.rint(sums[:, 0]).astype(np.int64), sums[:, 1]
    alls, dying = sums[:, 2 : 3 + p], sums[:, 3 + p :]
    risk = np.cumsum(alls[::-1], axis=0)[::-1] + longer[chunk]
    t = np.zeros((len(d), 6))
    with np.errstate(all="ignore"):  # a risk that underflows gives an infinite likelihood, and the step is refused
        for r in np.flatnonzero(deaths):
            t[r] = _tie_sums(int(deaths[r]), risk[r, 0], dying[r, 0], ties)
        mixed = (risk[:, 1:] * t[:, 4:5]).T @ dying[:, 1:]
        outer = (risk[:, 1:] * t[:, 3:4]).T @ risk[:, 1:] - mixed - mixed.T + (dying[:, 1:] * t[:, 5:6]).T @ dying[:, 1:]
        up = np.cumsum(t[:, 1])
        ll = eta.sum() - t[:, 0].sum()
    each = pd.DataFrame({"_chunk": chunk, "d": d, "up": up, "own": t[:, 2], "ll": None, "outer": None})
    whole = pd.DataFrame({"_chunk": [chunk], "d": [None], "up": [up[-1]], "own": [None], "ll": [ll], "outer": [outer.ravel().tolist()]})
    return pd.concat([each.astype({"ll": float}), whole.astype({"d": float, "own": float})], ignore_index=True)


def _row_terms(beta: np.ndarray, top: float, before: dict[int, float], p: int, slots: int = 64):
    """Per task: sum of (event - v) * z and of v * z z' with v = risk * (1/risk set summed over the deaths up to the row's duration).

    Tasks share ``slots`` slots, so that the next step adds up in parallel and the driver gets that many rows at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p + p * p)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            chunk, d, e, z = _columns_of(batch)
            up, own = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("up", "own"))
            v = np.exp(z @ beta - top) * (up + np.array([before[int(c)] for c in chunk]) - e * own)
            total[:p] += (e - v) @ z
            total[p:] += ((z * v[:, None]).T @ z).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % slots]), _lists(total[None, :])], ["slot", "sums"])

    return run


def _merge_slot(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"slot": rows["slot"].iloc[:1], "sums": [np.stack(rows["sums"].to_numpy()).sum(axis=0).tolist()]})


def fit_cox(
    df: DataFrame, columns: Sequence[str] | None = None, *, ridge: float = 0.1, ties: str = "efron", max_steps: int = 25, tolerance: float = 1e-7
) -> CoxModel:
    """Ridge-penalised proportional hazards; missing covariates count as 0.

    Every sum over risk sets is turned round: a row counts in the risk set of each death up to its own duration, so the gradient and the
    second moments need one weight per row, and only sums that are linear in the covariates are kept per duration. Durations are cut into
    ranges once; a step adds up per task (a duration shared by most rows, such as the censoring horizon, is cheap), solves the chunks, and
    joins their two figures per duration back to the rows. The driver sees p * p numbers per chunk and per slot of tasks.
    """
    names = list(columns or covariate_columns(df))
    data = df.where(F.col("duration").isNotNull() & F.col("event").isNotNull())
    names = varying_columns(data, names)
    if not names:
        raise ValueError("no covariate varies")
    p = len(names)
    filled = clean_matrix(data, names)
    figures = filled.agg(F.count("*").alias("n"), *[f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    n, means, stds = figures["n"], [figures[f"m{i}"] for i in range(p)], [figures[f"s{i}"] for i in range(p)]
    z = F.array(*[(F.col(c) - means[i]) / stds[i] for i, c in enumerate(names)])
    with scratch() as cuts:
        rows = cuts.cut(filled.select(F.col("duration").cast("double").alias("d"), F.col("event").cast("int").alias("e"), z.alias("z")))
        times = cuts.cut(rows.select("d").distinct())
        # enough chunks that one holds at most about ten million sums
        wanted = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), times.count() * 2 * (2 + p) // 10_000_000 + 1)
        rows = cuts.cut(rows.join(cuts.cut(range_chunks(times, ["d"], wanted).select("d", "_chunk")), "d").select("_chunk", "d", "e", "z"))
        return _newton(rows, names, means, stds, n, ridge, ties, max_steps, tolerance)


def _newton(rows: DataFrame, names: list[str], means: list[float], stds: list[float], n: int, ridge: float, ties: str, max_steps: int, tolerance: float) -> CoxModel:
    p = len(names)

    def terms(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        with scratch() as cuts:
            totals = rows.mapInArrow(_chunk_sums(beta), "_chunk bigint, top double, sums array<double>")
            totals = totals.groupBy("_chunk").applyInPandas(_merge_chunk, "_chunk bigint, top double, sums array<double>").collect()
            top = max(r["top"] for r in totals)  # taken off every score: it cancels, and no exponential overflows
            longer, running = {}, np.zeros(1 + p)
            for r in sorted(totals, key=lambda r: -r["_chunk"]):
                longer[int(r["_chunk"])] = running
                running = running + np.array(r["sums"]) * np.exp(r["top"] - top)
            per_d = rows.mapInArrow(_duration_sums(beta, top), "_chunk bigint, d double, sums array<double>")
            shape = "_chunk bigint, d double, up double, own double, ll double, outer array<double>"
            solved = cuts.cut(per_d.groupBy("_chunk").applyInPandas(lambda part: _chunk_terms(part, longer, p, ties), shape))
            parts = solved.where("d is null").orderBy("_chunk").collect()  # one row per chunk
            before = dict(zip((int(r["_chunk"]) for r in parts), np.cumsum([0.0, *(r["up"] for r in parts)])))
            ll = sum(r["ll"] for r in parts) - 0.5 * ridge * n * float(beta @ beta)
            if not np.isfinite(ll):
                return -np.inf, np.zeros(p), np.zeros((p, p))
            placed = rows.join(solved.where("d is not null").select("d", "up", "own"), "d")
            sums = placed.mapInArrow(_row_terms(beta, top, before, p), "slot bigint, sums array<double>")
            slots = sums.groupBy("slot").applyInPandas(_merge_slot, "slot bigint, sums array<double>").collect()
            total = np.sum([np.array(r["sums"]) for r in slots], axis=0)
            grad = total[:p] - ridge * n * beta
            outer = np.sum([np.array(r["outer"]) for r in parts], axis=0).reshape(p, p)
            return ll, grad, outer - total[p:].reshape(p, p) - ridge * n * np.eye(p)

    beta = np.zeros(p)
    ll, grad, hess = terms(beta)
    steps, converged = 0, False
    while steps < max_steps and not converged:
        steps += 1
        bump = 0.0
        while True:
            try:
                move = np.linalg.solve(-hess + bump * np.eye(p), grad)
                break
            except np.linalg.LinAlgError:
                bump = max(bump * 10, 1e-6)
        size = 1.0
        while True:
            trial = beta + size * move
            new = terms(trial)
            if np.isfinite(new[0]) and new[0] >= ll - 1e-9 * max(1.0, abs(ll)):
                break
            size /= 2
            if np.abs(size * move).max() < tolerance:  # no step along this direction gains: the old coefficients stay
                trial, new = beta, (ll, grad, hess)
                break
        converged = bool(np.abs(trial - beta).max() < tolerance)
        beta, (ll, grad, hess) = trial, new
    if not converged:
        warnings.warn(f"no convergence in {max_steps} steps", stacklevel=2)
    own = (beta / np.array(stds)).tolist()
    model = CoxModel(names, means, own, [], steps, float(ll), converged)
    model.baseline = _hourly_baseline(rows, beta)
    return model


def _hourly_baseline(rows: DataFrame, beta: np.ndarray, horizon: int = HORIZON) -> list[tuple]:
    """Cumulative baseline hazard next to every whole hour; at most two durations per hour are kept."""
    weights = F.array(*[F.lit(float(b)) for b in beta])
    score = F.aggregate(F.zip_with("z", weights, lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
    per_d = rows.groupBy("d").agg(F.sum(F.exp(score)).alias("w"), F.sum("e").alias("m"))
    at_risk = running_sums(per_d.withColumn("_minus_d", -F.col("d")), ["_minus_d"], {"risk": F.col("w")}).select("d", "m", "risk")
    hazard = running_sums(at_risk, ["d"], {"h": F.col("m") / F.col("risk")}).select("d", "h")
    slot = F.least(F.ceil("d"), F.lit(horizon + 1)).cast("int")
    edges = hazard.groupBy(slot.alias("slot")).agg(F.min("d").alias("d0"), F.min_by("h", "d").alias("h0"), F.max("d").alias("d1"), F.max_by("h", "d").alias("h1"))
    by_slot = {r["slot"]: r for r in edges.collect()}  # at most one row per hour
    out = []
    for hour in range(horizon + 1):
        before = next((by_slot[s] for s in range(hour, -1, -1) if s in by_slot), None)
        after = next((by_slot[s] for s in range(hour + 1, horizon + 2) if s in by_slot), None)
        out.append(
            (
                float(hour),
                before["d1"] if before else None,
                before["h1"] if before else None,
                after["d0"] if after else None,
                after["h0"] if after else None,
            )
        )
    return out


# --- boosted times ------------------------------------------------------------------------


def boosting_target(df: DataFrame, output: str = "_target") -> DataFrame:
    """-ln(duration), and for censored rows -ln of the longest duration."""
    longest = df.agg(F.max("duration").cast("double").alias("_longest"))  # one row
    d = F.when(F.col("event") == 1, F.col("duration").cast("double")).otherwise(F.col("_longest"))
    return df.join(F.broadcast(longest), F.lit(True)).withColumn(output, -F.log(d + 1e-6)).drop("_longest")


@dataclass
class BoostedModel:
    columns: list[str]
    model: GBTRegressionModel | Trees
    scale: float  # largest absolute hazard seen in training

    def hazard(self, df: DataFrame, output: str = "hazard_score") -> DataFrame:
        if isinstance(self.model, Trees):
            cleaned = clean_matrix(df.select("*", *[F.col(c).alias(f"_x_{c}") for c in self.columns]), [f"_x_{c}" for c in self.columns])
            x = F.array(*[F.col(f"_x_{c}") for c in self.columns])
            return cleaned.withColumn(output, margin_column(self.model, x)).drop(*[f"_x_{c}" for c in self.columns])
        vec = VectorAssembler(inputCols=self.columns, outputCol="_vec").transform(clean_matrix(df, self.columns))
        return self.model.setFeaturesCol("_vec").setPredictionCol(output).transform(vec).drop("_vec")

    def curve(self, df: DataFrame, output: str = "curve", scale: str = "train", around: Sequence[float] | None = None) -> DataFrame:
        return exponential_curve(self.hazard(df, "_h"), "_h", output, scale=self.scale if scale == "train" else None, around=around).drop("_h")

    def importances(self, spark: SparkSession) -> DataFrame:
        share = self.model.importances(len(self.columns)) if isinstance(self.model, Trees) else self.model.featureImportances
        rows = [(c, float(share[i])) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def exponential_curve(
    df: DataFrame, hazard: str, output: str, *, scale: float | None = None, horizon: int = HORIZON, around: Sequence[float] | None = None
) -> DataFrame:
    """Hourly exp(-h / scale * t) clipped to 0..1; without a scale the batch's largest |h| is used. With ``around``, only the points beside those hours."""
    if scale is None:
        top = df.agg(F.max(F.abs(hazard)).alias("_top"))  # one row
        out = df.join(F.broadcast(top), F.lit(True))
        unit = F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    else:
        out, unit = df, F.lit(scale if scale > 0 else 1.0)
    h = F.col(hazard) / unit
    value = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-h * t)))
    every = range(horizon + 1)
    hours = F.sequence(F.lit(0), F.lit(horizon)) if around is None else F.array(*[F.lit(t) for t in beside_hours(every, every, around)])
    return out.withColumn(output, F.transform(hours, lambda t: F.struct(t.cast("double").alias("t"), value(t).alias("s")))).drop("_top")


def fit_boosted(
    df: DataFrame, columns: Sequence[str] | None = None, *, trees: int = 100, depth: int = 3, rate: float = 0.1, seed: int = 42
) -> BoostedModel:
    names = list(columns or covariate_columns(df))
    data = df.where(F.col("duration").isNotNull() & F.col("event").isNotNull())
    names = varying_columns(data, names)
    vec = VectorAssembler(inputCols=names, outputCol="_vec").transform(clean_matrix(boosting_target(data), names))
    fitted = GBTRegressor(featuresCol="_vec", labelCol="_target", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed).fit(vec)
    model = BoostedModel(names, fitted, 1.0)
    top = model.hazard(data, "_h").agg(F.max(F.abs("_h"))).first()[0]
    model.scale = float(top or 1.0)
    return model


# --- training, scoring --------------------------------------------------------------------


def train_survival(
    df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, *, kinds: Sequence[str] = ("cox", "gb"), options: dict | None = None
) -> tuple[dict, DataFrame]:
    """Each model on the earlier 80 % of the rows: (models, table of sizes and concordance)."""
    split = durable(tail_split(df, order))
    train, test = split.where("not is_test").drop("is_test"), split.where("is_test").drop("is_test")
    models, rows = {}, []
    sizes = split.agg(F.count_if(~F.col("is_test")).alias("a"), F.count_if("is_test").alias("b")).first()
    for kind in kinds:
        fit = fit_cox if kind == "cox" else fit_boosted
        model = models[kind] = fit(train, columns, **(options or {}).get(kind, {}))
        index = [concordance(model.hazard(part, "_risk"), score="_risk").first()["c_index"] for part in (train, test)]
        rows.append((kind, sizes["a"], sizes["b"], *[None if v is None else float(v) for v in index]))
    table = df.sparkSession.createDataFrame(rows, "model string, train_rows bigint, test_rows bigint, train_c_index double, test_c_index double")
    return models, table


def score_survival(model, df: DataFrame, keep: Sequence[str], *, kind: str = "cox", buckets: Sequence[int] = BUCKET_HOURS) -> DataFrame:
    """Hazard, hourly curve and bucket probabilities of every row. The latter read few points of the curve, so only these are made for them."""
    scored = model.curve(model.curve(model.hazard(df), "curve"), "_ends", around=buckets)
    return scored.select(*keep, "hazard_score", "curve", bucket_probabilities(F.col("_ends"), buckets).alias("probability_distribution"), F.lit(kind).alias("model_type"))


def linear_contributions(model: CoxModel, df: DataFrame, keep: Sequence[str], n: int = 15) -> DataFrame:
    """The n largest terms beta * (x - mean) of each row (feature, value, rank)."""
    terms = df.select(*keep, *[c.alias(name) for name, c in model.contributions().items()])
    return top_contributions(terms, model.columns, keep, n)


def as_log_rows(scored: DataFrame, prediction_type: str, ts: str = "timestamp") -> DataFrame:
    return scored.withColumn("prediction_type", F.lit(prediction_type)).withColumnRenamed(ts, "observation_timestamp")

