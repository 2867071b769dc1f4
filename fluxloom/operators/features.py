"""Point-in-time features: trailing-window figures of a series for every grid row.

Every operator takes a grid (keys + time) and a series, and gives one row per grid row.
None makes (grid row, sample) pairs: see ``plans.ranges``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluxloom.functions.missing import nan_as_null
from fluxloom.functions.classes import FILTER_RANK, rank_of
from fluxloom.functions.magnetic import magnetic_flags, magnetic_score, sunspot_codes, sunspot_letters, sunspot_score
from fluxloom.functions.timing import HOUR_US, from_micros, hours_to_us, micros
from fluxloom.plans.ordering import running_index, running_sums
from fluxloom.plans.quantiles import range_medians
from fluxloom.plans.ranges import Part, range_aggregate

TS = "timestamp"


def _finest(spans: Sequence[int]) -> int:
    return max(min(spans) // 16, 1_000_000)


def trailing_ranges(grid: DataFrame, windows: Sequence[tuple[str, int, int]], *, keys: Sequence[str], ts: str = TS) -> DataFrame:
    """One range [t - back, t + ahead] per grid row and window (label, back, ahead)."""
    spec = ", ".join(f"named_struct('_w', '{w}', 'b', {b}L, 'a', {a}L)" for w, b, a in windows)
    at = grid.select(*keys, ts, micros(ts).alias("_t"), F.expr(f"inline(array({spec}))"))
    return at.selectExpr(*keys, ts, "_t", "_w", "_t - b as lo", "_t + a as hi")


def trailing(
    grid: DataFrame,
    series: DataFrame,
    *,
    keys: Sequence[str],
    windows: Sequence[tuple[str, int, int]],
    parts: Sequence[Part],
    finals: Sequence[Column],
    ts: str = TS,
    series_ts: str = TS,
    base: int | None = None,
) -> DataFrame:
    """Aggregates per grid row over labelled windows; ``finals`` select one by ``in_window``."""
    spans = [b + a for _, b, a in windows]
    samples = series.withColumn("us", micros(series_ts))
    return range_aggregate(
        trailing_ranges(grid, windows, keys=keys, ts=ts),
        samples,
        keys=keys,
        group=[*keys, ts],
        parts=parts,
        finals=finals,
        base=base or _finest(spans),
        longest=max(spans),
    )


def in_window(label: str, value: str) -> str:
    return f"CASE WHEN _w = '{label}' THEN {value} END"


def named(expression: str, name: str) -> Column:
    return F.expr(expression).alias(name)


# --- moments -----------------------------------------------------------------------------


def moment_parts(column: str) -> list[Part]:
    v = f"nanvl(cast({column} as double), cast(null as double))"  # NaN counts as missing
    return [
        Part(f"{column}_n", f"cast({v} is not null as bigint)", "sum"),
        Part(f"{column}_s", v, "sum"),
        Part(f"{column}_q", f"{v} * {v}", "sum"),
        Part(f"{column}_lo", v, "min"),
        Part(f"{column}_hi", v, "max"),
    ]


def sample_std(n: str, s: str, q: str) -> str:
    """Sample standard deviation from count, sum and sum of squares; null below two values.

    A spread under the resolution of the sums (a constant series) is zero.
    """
    spread = f"({q} - {s} * {s} / {n})"
    return f"CASE WHEN {n} >= 2 THEN sqrt(CASE WHEN {spread} > {q} * 1e-14 THEN {spread} ELSE 0e0 END / ({n} - 1)) END"


def _stat(column: str, label: str, fn: str) -> str:
    n, s, q = (f"sum({in_window(label, f'{column}_{m}')})" for m in ("n", "s", "q"))
    return {
        "count": f"coalesce({n}, 0L)",
        "sum": s,
        "mean": f"CASE WHEN {n} > 0 THEN {s} / {n} END",
        "std": sample_std(n, s, q),
        "min": f"min({in_window(label, f'{column}_lo')})",
        "max": f"max({in_window(label, f'{column}_hi')})",
    }[fn]


def rolling_stats(
    grid: DataFrame,
    series: DataFrame,
    columns: Sequence[str],
    *,
    windows: Sequence[int] = (6, 12, 24),
    functions: Sequence[str] = ("mean", "std", "min", "max"),
    keys: Sequence[str] = (),
    ts: str = TS,
) -> DataFrame:
    """``{column}_{window}h_{function}`` over [t - window, t]; nulls skipped, empty gives null."""
    spec = [(f"{w}h", hours_to_us(w), 0) for w in windows]
    plain = [f for f in functions if f != "median"]
    out = trailing(
        grid,
        series,
        keys=keys,
        windows=spec,
        parts=[p for c in columns for p in moment_parts(c)],
        finals=[named(_stat(c, w, f), f"{c}_{w}_{f}") for c in columns for w, _, _ in spec for f in plain or ["count"]],
        ts=ts,
    )
    if "median" in functions:
        out = out.join(_rolling_medians(grid, series, columns, spec, keys=keys, ts=ts), [*keys, ts], "left")
    return out


def _rolling_medians(
    grid: DataFrame, series: DataFrame, columns: Sequence[str], spec: Sequence[tuple[str, int, int]], *, keys: Sequence[str], ts: str
) -> DataFrame:
    """Medians of all columns and windows in one pass, the column being one more key."""
    each = ", ".join(f"named_struct('_col', '{c}', '_value', cast({c} as double))" for c in columns)
    names = ", ".join(f"'{c}'" for c in columns)
    backs = [b for _, b, _ in spec]
    medians = range_medians(
        trailing_ranges(grid, spec, keys=keys, ts=ts).withColumn("_col", F.expr(f"explode(array({names}))")),
        series.select(*keys, micros(TS).alias("us"), F.expr(f"inline(array({each}))")),
        keys=[*keys, "_col"],
        group=[*keys, "_col", ts, "_w"],
        value="_value",
        base=_finest(backs),
        longest=max(backs),
    )
    picks = [named(f"max(CASE WHEN _w = '{w}' AND _col = '{c}' THEN median END)", f"{c}_{w}_median") for c in columns for w, _, _ in spec]
    return medians.groupBy(*keys, ts).agg(*picks)


# --- trends ------------------------------------------------------------------------------


def flux_summary(grid: DataFrame, flux: DataFrame, *, keys: Sequence[str] = (), hours: int = 24, ts: str = TS) -> DataFrame:
    """Mean, max, min, std of both bands over the last ``hours`` and the hardness ratio of the means."""
    label = "d"
    finals = [
        named(_stat(f"flux_{band}", label, fn), f"flux_{band}_{fn}") for band in ("short", "long") for fn in ("mean", "max", "min", "std")
    ]
    parts = moment_parts("flux_short") + moment_parts("flux_long")
    out = trailing(grid, flux, keys=keys, windows=[(label, hours_to_us(hours), 0)], parts=parts, finals=finals, ts=ts)
    return out.withColumn("flux_ratio_short_long", hardness(F.col("flux_short_mean"), F.col("flux_long_mean")))


def hardness(short_mean: Column, long_mean: Column) -> Column:
    """Ratio of the band means; null when either is null or zero, or the long one is not positive."""
    return F.when((short_mean != 0) & (long_mean > 0), short_mean / long_mean)


def index_trend(grid: DataFrame, flux: DataFrame, *, keys: Sequence[str] = (), hours: int = 6, ts: str = TS) -> DataFrame:
    """Least-squares slope of the last non-null samples against 0, 1, 2, ...

    The slope does not change when the index is shifted, so one running number per series
    serves every window; consecutive numbers make the index spread n(n^2-1)/12.
    """
    flux = nan_as_null(flux)
    bands = ("short", "long")
    marks = {f"_i_{b}": F.col(f"flux_{b}").isNotNull().cast("bigint") for b in bands}
    numbered = running_sums(flux.select(*keys, TS, "flux_short", "flux_long"), [TS], marks, keys)
    parts, finals = [], []
    for b in bands:
        i = f"CASE WHEN flux_{b} IS NOT NULL THEN cast(_i_{b} as double) END"
        parts += [
            Part(f"{b}_n", f"cast(flux_{b} is not null as bigint)", "sum"),
            Part(f"{b}_s", f"flux_{b}", "sum"),
            Part(f"{b}_iv", f"{i} * flux_{b}", "sum"),
            Part(f"{b}_i0", i, "min"),
        ]
        n = f"cast(sum({b}_n) as double)"
        slope = f"(sum({b}_iv) - (min({b}_i0) + ({n} - 1) / 2) * sum({b}_s)) / ({n} * ({n} * {n} - 1) / 12)"
        finals.append(named(f"CASE WHEN {n} >= 2 THEN {slope} END", f"flux_trend_{b}"))
    return trailing(grid, numbered, keys=keys, windows=[("w", hours_to_us(hours), 0)], parts=parts, finals=finals, ts=ts)


def _change_parts(bands: Sequence[str]) -> list[Part]:
    parts = [Part("rows", "1L", "sum"), Part("t0", "us", "min"), Part("t1", "us", "max")]
    for b in bands:
        at = f"CASE WHEN flux_{b} IS NOT NULL THEN us END"
        parts += [
            Part(f"{b}_n", f"cast(flux_{b} is not null as bigint)", "sum"),
            Part(f"{b}_first", f"flux_{b}", "first_by", f"{b}_u0"),
            Part(f"{b}_last", f"flux_{b}", "last_by", f"{b}_u1"),
            Part(f"{b}_u0", at, "min"),
            Part(f"{b}_u1", at, "max"),
        ]
    return parts


def _change(b: str, label: str) -> tuple[str, str]:
    """(last minus first non-null value, number of non-null values)."""
    first, last, u0, u1, n = (in_window(label, f"{b}_{m}") for m in ("first", "last", "u0", "u1", "n"))
    return f"(max_by({last}, {u1}) - min_by({first}, {u0}))", f"coalesce(sum({n}), 0L)"


def _span_hours(label: str) -> str:
    return f"((max({in_window(label, 't1')}) - min({in_window(label, 't0')})) / 3.6e9)"


def rate_of_change(grid: DataFrame, flux: DataFrame, *, keys: Sequence[str] = (), hours: int = 12, ts: str = TS) -> DataFrame:
    """Change per hour: last minus first non-null value over the time span of all rows."""
    flux = nan_as_null(flux)
    bands, label = ("short", "long"), "w"
    finals = []
    for b in bands:
        (diff, valid), span = _change(b, label), _span_hours(label)
        finals.append(named(f"CASE WHEN {valid} >= 2 AND {span} > 0 THEN {diff} / {span} END", f"flux_{b}_rate_of_change"))
    return trailing(grid, flux, keys=keys, windows=[(label, hours_to_us(hours), 0)], parts=_change_parts(bands), finals=finals, ts=ts)


def acceleration(grid: DataFrame, flux: DataFrame, *, keys: Sequence[str] = (), hours: int = 12, ts: str = TS) -> DataFrame:
    """Rate of the later half of the window's rows minus that of the earlier half, per hour.

    The row that opens the later half is found by its running number: rows of a window are
    consecutive, so it is the first number plus n // 2, an equi-join away.
    """
    flux = nan_as_null(flux)
    bands, back = ("short", "long"), hours_to_us(hours)
    indexed = running_index(flux.select(*keys, TS, "flux_short", "flux_long"), [TS], keys, name="_i")
    sizes = trailing(
        grid,
        indexed,
        keys=keys,
        windows=[("w", back, 0)],
        parts=[Part("rows", "1L", "sum"), Part("i0", "_i", "min")],
        finals=[F.coalesce(F.sum("rows"), F.lit(0)).alias("_n"), F.min("i0").alias("_i0")],
        ts=ts,
    )
    middle = sizes.where(F.col("_n") >= 3).withColumn("_i", F.col("_i0") + F.expr("_n div 2"))
    split = middle.join(indexed.select(*keys, "_i", micros(TS).alias("_split")), [*keys, "_i"]).withColumn("_t", micros(ts))
    halves = split.withColumn(
        "_x",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("w"), (F.col("_t") - back).alias("lo"), (F.col("_split") - 1).alias("hi")),
                F.struct(F.lit("b").alias("w"), F.col("_split").alias("lo"), F.col("_t").alias("hi")),
            )
        ),
    ).select(*keys, ts, F.col("_x.w").alias("_w"), F.col("_x.lo").alias("lo"), F.col("_x.hi").alias("hi"))
    finals = []
    for b in bands:
        (d1, n1), (d2, n2) = _change(b, "a"), _change(b, "b")
        h1, h2 = _span_hours("a"), _span_hours("b")
        usable = f"{n1} >= 2 AND {n2} >= 2 AND {h1} > 0 AND {h2} > 0"
        finals.append(named(f"CASE WHEN {usable} THEN ({d2} / {h2} - {d1} / {h1}) / ({h1} + {h2}) END", f"flux_{b}_acceleration"))
    found = range_aggregate(
        halves,
        indexed.withColumn("us", micros(TS)),
        keys=keys,
        group=[*keys, ts],
        parts=_change_parts(bands),
        finals=finals,
        base=_finest([back]),
        longest=back,
    )
    return grid.select(*keys, ts).distinct().join(found, [*keys, ts], "left")


# --- event history -----------------------------------------------------------------------


def _hours(us: Column) -> Column:
    return us / F.lit(float(HOUR_US))


def _lift_x(n: str, x: str):
    return lambda d: F.col(x) + F.col(n) * _hours(d)


def _lift_xx(n: str, x: str, xx: str):
    return lambda d: F.col(xx) + 2 * _hours(d) * F.col(x) + F.col(n) * _hours(d) * _hours(d)


def _lift_xv(s: str, xv: str):
    return lambda d: F.col(xv) + _hours(d) * F.col(s)


def weighted_counts(
    grid: DataFrame,
    events: DataFrame,
    *,
    keys: Sequence[str] = (),
    classes: Sequence[str] = ("B", "C", "M", "X"),
    windows: Sequence[int] = (6, 12, 24),
    decay: float = 0.9,
    event_ts: str = "start_time",
    ts: str = TS,
) -> DataFrame:
    """Event counts and sums of ``decay ** hours_ago`` per class and window [t - w, t].

    The weight splits into a factor of the sample (to its cell's start) and one of the grid
    row, so weighted sums merge like counts.
    """
    spec = [(f"{w}h", hours_to_us(w), 0) for w in windows]
    weight = f"pow({decay}, -(us - origin) / 3.6e9)"

    def weighted(name: str, value: str) -> Part:
        return Part(name, value, "sum", lift=lambda shift: F.col(name) * F.pow(F.lit(decay), -_hours(shift)))

    parts = [weighted("w_all", weight)]
    for c in classes:
        hit = f"class_category = '{c}'"
        parts += [Part(f"n_{c}", f"cast({hit} as bigint)", "sum"), weighted(f"w_{c}", f"CASE WHEN {hit} THEN {weight} END")]
    age = f"pow({decay}, (_t - origin) / 3.6e9)"
    total = lambda w, part: f"coalesce(sum({in_window(w, f'{part} * {age}')}), 0e0)"
    finals = []
    for w, _, _ in spec:
        for c in classes:
            finals.append(named(f"coalesce(sum({in_window(w, f'n_{c}')}), 0L)", f"flare_{c}_{w}_count"))
            finals.append(named(total(w, f"w_{c}"), f"flare_{c}_{w}_weighted_count"))
        finals.append(named(total(w, "w_all"), f"flare_total_{w}_weighted_count"))
    return trailing(grid, events, keys=keys, windows=spec, parts=parts, finals=finals, ts=ts, series_ts=event_ts)


LOOKBACKS = (1, 3, 6, 12, 24)


def flux_covariates(
    grid: DataFrame, flux: DataFrame, *, keys: Sequence[str] = (), lookbacks: Sequence[int] = LOOKBACKS, ts: str = TS
) -> DataFrame:
    """Mean, max and slope against hours of both bands per lookback; empty gives 0."""
    flux = nan_as_null(flux)
    spec = [(f"{w}h", hours_to_us(w), 0) for w in lookbacks]
    parts, finals = [], []
    off = "((origin - _t) / 3.6e9)"
    for b in ("long", "short"):
        v, n_, s_, x_, xx_, xv_ = f"flux_{b}", *(f"{b}_{m}" for m in ("n", "s", "x", "xx", "xv"))
        x = f"CASE WHEN {v} IS NOT NULL THEN (us - origin) / 3.6e9 END"
        parts += [
            Part(n_, f"cast({v} is not null as bigint)", "sum"),
            Part(s_, v, "sum"),
            Part(f"{b}_m", v, "max"),
            Part(x_, x, "sum", lift=_lift_x(n_, x_)),
            Part(xx_, f"({x}) * ({x})", "sum", lift=_lift_xx(n_, x_, xx_)),
            Part(xv_, f"({x}) * {v}", "sum", lift=_lift_xv(s_, xv_)),
        ]
        for w, _, _ in spec:
            total = lambda value: f"sum({in_window(w, value)})"
            n, s = f"cast({total(n_)} as double)", total(s_)
            sx, sxx = total(f"{x_} + {n_} * {off}"), total(f"{xx_} + 2 * {off} * {x_} + {n_} * {off} * {off}")
            sxv = total(f"{xv_} + {off} * {s_}")
            spread = f"({sxx} - {sx} * {sx} / {n})"
            slope = f"CASE WHEN {n} >= 2 AND {spread} > 1e-16 THEN ({sxv} - {sx} * {s} / {n}) / {spread} END"
            finals += [
                named(f"coalesce(CASE WHEN {n} > 0 THEN {s} / {n} END, 0e0)", f"flux_{b}_mean_{w}"),
                named(f"coalesce(max({in_window(w, f'{b}_m')}), 0e0)", f"flux_{b}_max_{w}"),
                named(f"coalesce({slope}, 0e0)", f"flux_{b}_trend_{w}"),
            ]
    return trailing(grid, flux, keys=keys, windows=spec, parts=parts, finals=finals, ts=ts)


def region_covariates(
    grid: DataFrame, regions: DataFrame, *, keys: Sequence[str] = (), lookbacks: Sequence[int] = LOOKBACKS, ts: str = TS
) -> DataFrame:
    """Highest scores and mean area of the region rows per lookback; empty gives 0."""
    spec = [(f"{w}h", hours_to_us(w), 0) for w in lookbacks]
    scored = regions.withColumn("_mc", sunspot_score("mcintosh_class")).withColumn("_mw", magnetic_score("mount_wilson_class"))
    area = F.col("area").cast("double")
    parts = [
        Part("mc", F.col("_mc"), "max"),
        Part("mw", F.col("_mw"), "max"),
        Part("best", F.greatest("_mc", "_mw"), "max"),
        Part("a_n", area.isNotNull().cast("bigint"), "sum"),
        Part("a_s", area, "sum"),
    ]
    finals = []
    for w, _, _ in spec:
        top = lambda part: f"coalesce(max({in_window(w, part)}), 0e0)"
        n, area_sum = (f"sum({in_window(w, part)})" for part in ("a_n", "a_s"))
        finals += [
            named(top("best"), f"max_complexity_{w}"),
            named(f"coalesce(CASE WHEN {n} > 0 THEN {area_sum} / {n} END, 0e0)", f"avg_area_{w}"),
            named(top("mc"), f"max_mcintosh_{w}"),
            named(top("mw"), f"max_mount_wilson_{w}"),
        ]
    return trailing(grid, scored, keys=keys, windows=spec, parts=parts, finals=finals, ts=ts)


def event_covariates(
    grid: DataFrame, events: DataFrame, *, keys: Sequence[str] = (), lookbacks: Sequence[int] = LOOKBACKS, ts: str = TS
) -> DataFrame:
    """Count, strongest class and hours since the last peak in [t - w, t); empty gives 0, 0, w."""
    spec = [(f"{w}h", hours_to_us(w), -1) for w in lookbacks]
    parts = [
        Part("n", F.lit(1).cast("bigint"), "sum"),
        Part("top", rank_of("class_category", FILTER_RANK), "max"),
        Part("last", F.col("us"), "max"),
    ]
    finals = []
    for (w, _, _), hours in zip(spec, lookbacks):
        since = f"(max({in_window(w, '_t')}) - max({in_window(w, 'last')})) / 3.6e9"
        finals += [
            named(f"coalesce(sum({in_window(w, 'n')}), 0L)", f"flare_count_{w}"),
            named(f"coalesce(max({in_window(w, 'top')}), 0)", f"max_flare_class_{w}"),
            named(f"coalesce({since}, {float(hours)}e0)", f"hours_since_last_flare_{w}"),
        ]
    return trailing(grid, events, keys=keys, windows=spec, parts=parts, finals=finals, ts=ts, series_ts="peak_time")


# --- as-of -------------------------------------------------------------------------------


def asof_region(
    grid: DataFrame, regions: DataFrame, *, keys: Sequence[str] = (), hours: int = 48, pick: str = "newest", ts: str = TS
) -> DataFrame:
    """Region row in force at each grid row: newest (or oldest) of the last ``hours``.

    Rows of the same time are ordered by region number.
    """
    rest = [c for c in regions.columns if c not in keys and c not in (TS, "us", "region_number")]
    row = F.struct(F.col("us").alias("u"), F.col("region_number"), *rest)
    merge, choose = ("max", F.max) if pick == "newest" else ("min", F.min)
    out = trailing(
        grid, regions, keys=keys, windows=[("w", hours_to_us(hours), 0)], parts=[Part("row", row, merge)],
        finals=[choose("row").alias("_r")], ts=ts, base=max(hours_to_us(hours) // 96, 1),
    )
    return out.select(
        *keys, ts, from_micros(F.col("_r.u")).alias("region_time"), F.col("_r.region_number").alias("region_number"), *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


# --- composites --------------------------------------------------------------------------


def build_features(
    grid: DataFrame,
    flux: DataFrame,
    regions: DataFrame,
    events: DataFrame,
    *,
    keys: Sequence[str] = (),
    region_pick: str = "newest",
    windows: Sequence[int] = (6, 12, 24),
    ts: str = TS,
) -> DataFrame:
    """The full feature row of every grid row; missing numbers become 0."""
    points = grid.select(*keys, ts).distinct()
    region = asof_region(points, regions, keys=keys, pick=region_pick, ts=ts)
    mc, mw = F.col("mcintosh_class"), F.col("mount_wilson_class")
    size, shape, third = sunspot_letters(mc)
    size_c, shape_c, third_c = sunspot_codes(mc)
    has = set(region.columns)
    flags = magnetic_flags(mw)
    scored = region.select(
        *keys,
        ts,
        size.alias("mcintosh_size"),
        shape.alias("mcintosh_shape"),
        third.alias("mcintosh_penumbra"),
        size_c.alias("mcintosh_size_encoded"),
        shape_c.alias("mcintosh_shape_encoded"),
        third_c.alias("mcintosh_penumbra_encoded"),
        sunspot_score(mc).alias("mcintosh_complexity_score"),
        *[f.alias(f"mount_wilson_has_{w}") for w, f in flags.items()],
        magnetic_score(mw).alias("mount_wilson_complexity_score"),
        magnetic_score("magnetic_type" if "magnetic_type" in has else mw).alias("magnetic_complexity_score"),
        F.col("area").cast("double").alias("region_area"),
        F.col("num_sunspots").cast("double").alias("region_num_sunspots"),
        *[F.col(c).alias(f"region_{c}") for c in ("latitude", "longitude") if c in has],
    )
    pieces = [
        scored,
        flux_summary(points, flux, keys=keys, ts=ts),
        index_trend(points, flux, keys=keys, ts=ts),
        rate_of_change(points, flux, keys=keys, ts=ts),
        acceleration(points, flux, keys=keys, ts=ts),
        rolling_stats(points, flux, ["flux_short", "flux_long"], windows=windows, functions=["mean", "max", "std"], keys=keys, ts=ts),
        weighted_counts(points, events, keys=keys, windows=windows, ts=ts),
    ]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.join(p, [*keys, ts])
    numeric = [c for c, t in out.dtypes if t in ("double", "int", "bigint") and c not in keys]
    return out.fillna(0, numeric)


def build_covariates(
    grid: DataFrame,
    flux: DataFrame,
    regions: DataFrame,
    events: DataFrame,
    *,
    keys: Sequence[str] = (),
    lookbacks: Sequence[int] = LOOKBACKS,
    ts: str = TS,
) -> DataFrame:
    """Time-varying covariates of flux, regions and event history for every lookback."""
    points = grid.select(*keys, ts).distinct()
    return (
        flux_covariates(points, flux, keys=keys, lookbacks=lookbacks, ts=ts)
        .join(region_covariates(points, regions, keys=keys, lookbacks=lookbacks, ts=ts), [*keys, ts])
        .join(event_covariates(points, events, keys=keys, lookbacks=lookbacks, ts=ts), [*keys, ts])
    )


