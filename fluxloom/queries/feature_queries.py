"""Queries of joins, windows, features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.functions.timing import hours_to_us, micros
from fluxloom.operators import features, grids, labels
from fluxloom.plans.ranges import window_join
from fluxloom.queries.registry import ORACLES, expand_rounding, query, rounded
from fluxloom.queries.views import oracle, view

K = ["series_id"]

# The grid of the oracle texts: every 6 hours of each series' coverage.
GRID_SQL = """grid as (select series_id, unnest(generate_series(date_trunc('day', min(timestamp)), max(timestamp), interval 6 hour)) as timestamp
    from flux group by series_id)"""


def flux(s, d):
    return view(s, d, "flux").withColumn("series_id", F.col("series_id").cast("int"))


def grid(s, d, hours=6):
    return grids.regular_grid(grids.coverage_bounds(flux(s, d), keys=K), keys=K, hours=hours)


def over(body, *views):
    """Oracle text with the views and the grid in front."""
    names = ("flux", *[v for v in views if v != "flux"])
    return oracle(f"with {GRID_SQL},\n{body.strip()[5:]}" if body.strip().lower().startswith("with ") else f"with {GRID_SQL}\n{body}", *names)


_SQL_FN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median", "sum": "sum"}


def _w1_sql(windows=(6, 24), fns=("mean", "std", "min", "max", "median", "sum", "count")):
    cols = []
    for c in ("flux_short", "flux_long"):
        for w in windows:
            cond = f"filter (s.timestamp >= g.timestamp - interval {w} hour)"
            for fn in fns:
                cols.append(f"count(s.{c}) {cond} as {c}_{w}h_count" if fn == "count" else f"q_14({_SQL_FN[fn]}(s.{c}) {cond}) as {c}_{w}h_{fn}")
    return f"""select g.series_id, g.timestamp, {', '.join(cols)} from grid g left join flux s
        on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 24 hour and g.timestamp group by 1, 2"""


@query("w1_rolling_stats", over(_w1_sql()))
def w1(s, d):
    fns = ["mean", "std", "min", "max", "median", "count", "sum"]
    out = features.rolling_stats(grid(s, d), flux(s, d), ["flux_short", "flux_long"], windows=[6, 24], functions=fns, keys=K)
    return rounded(out, 14)


@query("w2_flux_summary", over(f"""select g.series_id, g.timestamp,
    {', '.join(f"q_14({f}(s.flux_{b})) as flux_{b}_{n}" for b in ('short', 'long') for n, f in (('mean', 'avg'), ('max', 'max'), ('min', 'min'), ('std', 'stddev_samp')))}
    from grid g left join flux s on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 24 hour and g.timestamp
    group by 1, 2"""))
def w2(s, d):
    return rounded(features.flux_summary(grid(s, d), flux(s, d), keys=K).drop("flux_ratio_short_long"), 14)


@query("w4_hardness_ratio", over("""select series_id, timestamp, q_8(case when a <> 0 and b > 0 then a / b end) as flux_ratio_short_long from (
    select g.series_id, g.timestamp, avg(s.flux_short) as a, avg(s.flux_long) as b
    from grid g left join flux s on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 24 hour and g.timestamp
    group by 1, 2) x"""))
def w4(s, d):
    return rounded(features.flux_summary(grid(s, d), flux(s, d), keys=K).select("series_id", "timestamp", "flux_ratio_short_long"), 8)


@query("w3_index_trend", over("""with numbered as (select *,
        count(flux_short) over (partition by series_id order by timestamp) as i, count(flux_long) over (partition by series_id order by timestamp) as j from flux)
    select g.series_id, g.timestamp,
      q_14(case when count(s.flux_short) >= 2 then regr_slope(s.flux_short, s.i) end) as flux_trend_short,
      q_14(case when count(s.flux_long) >= 2 then regr_slope(s.flux_long, s.j) end) as flux_trend_long
    from grid g left join numbered s on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 6 hour and g.timestamp
    group by 1, 2"""))
def w3(s, d):
    return rounded(features.index_trend(grid(s, d), flux(s, d), keys=K), 14)


def _rate(b, cond, src="s"):
    return f"""case when count({src}.flux_{b}) {cond} >= 2 and max({src}.timestamp) {cond} > min({src}.timestamp) {cond} then
        (arg_max({src}.flux_{b}, {src}.timestamp) filter ({src}.flux_{b} is not null) - arg_min({src}.flux_{b}, {src}.timestamp) filter ({src}.flux_{b} is not null))
        / ((epoch_us(max({src}.timestamp) {cond}) - epoch_us(min({src}.timestamp) {cond})) / 3.6e9) end"""


@query("w5_rate_of_change", over(f"""select g.series_id, g.timestamp, q_14({_rate('short', '')}) as flux_short_rate_of_change, q_14({_rate('long', '')}) as flux_long_rate_of_change
    from grid g left join flux s on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 12 hour and g.timestamp group by 1, 2"""))
def w5(s, d):
    return rounded(features.rate_of_change(grid(s, d), flux(s, d), keys=K), 14)


_HALVES = """, halves as (select series_id, gt, h, n, count(flux_short) as ns, count(flux_long) as nl,
      (epoch_us(max(st)) - epoch_us(min(st))) / 3.6e9 as hrs,
      arg_max(flux_short, st) filter (flux_short is not null) - arg_min(flux_short, st) filter (flux_short is not null) as ds,
      arg_max(flux_long, st) filter (flux_long is not null) - arg_min(flux_long, st) filter (flux_long is not null) as dl
    from (select *, case when r < n // 2 then 1 else 2 end as h from (
        select g.series_id, g.timestamp as gt, s.timestamp as st, s.flux_short, s.flux_long,
          row_number() over (partition by g.series_id, g.timestamp order by s.timestamp) - 1 as r,
          count(*) over (partition by g.series_id, g.timestamp) as n
        from grid g join flux s on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 12 hour and g.timestamp) x) y
    group by 1, 2, 3, 4)"""


@query("w6_acceleration", over(f"""with g0 as (select 1) {_HALVES}
    select g.series_id, g.timestamp,
      q_14(case when a.n >= 3 and a.ns >= 2 and b.ns >= 2 and a.hrs > 0 and b.hrs > 0 then (b.ds / b.hrs - a.ds / a.hrs) / (a.hrs + b.hrs) end) as flux_short_acceleration,
      q_14(case when a.n >= 3 and a.nl >= 2 and b.nl >= 2 and a.hrs > 0 and b.hrs > 0 then (b.dl / b.hrs - a.dl / a.hrs) / (a.hrs + b.hrs) end) as flux_long_acceleration
    from grid g left join halves a on a.series_id = g.series_id and a.gt = g.timestamp and a.h = 1
    left join halves b on b.series_id = g.series_id and b.gt = g.timestamp and b.h = 2"""))
def w6(s, d):
    return rounded(features.acceleration(grid(s, d), flux(s, d), keys=K), 14)


def _w8_sql():
    cols = []
    for w in (6, 12, 24):
        near = f"s.start_time >= g.timestamp - interval {w} hour"
        weight = "pow(0.9, (epoch_us(g.timestamp) - epoch_us(s.start_time)) / 3.6e9)"
        for c in "BCMX":
            cols.append(f"count(*) filter ({near} and s.class_category = '{c}') as flare_{c}_{w}h_count")
            cols.append(f"q_8(coalesce(sum({weight}) filter ({near} and s.class_category = '{c}'), 0)) as flare_{c}_{w}h_weighted_count")
        cols.append(f"q_8(coalesce(sum({weight}) filter ({near}), 0)) as flare_total_{w}h_weighted_count")
    return f"""select g.series_id, g.timestamp, {', '.join(cols)} from grid g left join flares s
        on s.series_id = g.series_id and s.start_time between g.timestamp - interval 24 hour and g.timestamp group by 1, 2"""


@query("w8_weighted_counts", over(_w8_sql(), "flares"))
def w8(s, d):
    return rounded(features.weighted_counts(grid(s, d), view(s, d, "flares"), keys=K), 8)


def _w9_sql():
    cols = []
    for w in (1, 3, 6, 12, 24):
        cond = f"filter (s.timestamp >= g.timestamp - interval {w} hour)"
        for b in ("long", "short"):
            v = f"s.flux_{b}"
            hours = "(epoch_us(s.timestamp) - epoch_us(g.timestamp)) / 3.6e9"
            cols.append(f"q_14(coalesce(avg({v}) {cond}, 0)) as flux_{b}_mean_{w}h")
            cols.append(f"q_14(coalesce(max({v}) {cond}, 0)) as flux_{b}_max_{w}h")
            cols.append(f"q_11(case when count({v}) {cond} >= 2 then regr_slope({v}, {hours}) {cond} else 0 end) as flux_{b}_trend_{w}h")
    return f"""select g.series_id, g.timestamp, {', '.join(cols)} from grid g left join flux s
        on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 24 hour and g.timestamp group by 1, 2"""


@query("w9_flux_covariates", over(_w9_sql()))
def w9(s, d):
    out = features.flux_covariates(grid(s, d), flux(s, d), keys=K)
    trends = [c for c in out.columns if "_trend_" in c]
    return rounded(rounded(out, 11, trends), 14, [c for c in out.columns if "_mean_" in c or "_max_" in c])


def mc_codes(col="mcintosh_class"):
    t = f"upper(trim({col}))"
    size = f"coalesce(case substr({t},1,1) when 'A' then 1 when 'B' then 2 when 'C' then 3 when 'D' then 4 when 'E' then 5 when 'F' then 6 when 'H' then 7 when 'J' then 8 end, 0)"
    part = lambda i: f"(case when length({t}) >= 3 then coalesce(case substr({t},{i},1) when 'X' then 0 when 'R' then 1 when 'S' then 2 when 'A' then 3 when 'H' then 4 when 'K' then 5 end, 0) else 0 end)"
    return size, part(2), part(3)


def mc_score(col="mcintosh_class"):
    a, b, c = mc_codes(col)
    return f"({a} / 8e0 * 0.4 + {b} / 5e0 * 0.3 + {c} / 5e0 * 0.3)"


def mw_score(col="mount_wilson_class"):
    t = f"lower(trim(coalesce({col}, '')))"
    has = lambda w, p: f"(case when contains({t}, '{w}') then {p} else 0 end)"
    return f"least(({has('alpha', 1)} + {has('beta', 2)} + {has('gamma', 3)} + {has('delta', 4)}) / 4e0, 1e0)"


def _w10_sql():
    cols = []
    for w in (1, 3, 6, 12, 24):
        cond = f"filter (s.timestamp >= g.timestamp - interval {w} hour)"
        cols.append(f"q_8(coalesce(max(greatest(s.mc, s.mw)) {cond}, 0)) as max_complexity_{w}h")
        cols.append(f"q_8(coalesce(avg(s.area) {cond}, 0)) as avg_area_{w}h")
        cols.append(f"q_8(coalesce(max(s.mc) {cond}, 0)) as max_mcintosh_{w}h")
        cols.append(f"q_8(coalesce(max(s.mw) {cond}, 0)) as max_mount_wilson_{w}h")
    return f"""with scored as (select *, {mc_score()} as mc, {mw_score()} as mw from regions)
      select g.series_id, g.timestamp, {', '.join(cols)} from grid g left join scored s
        on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 24 hour and g.timestamp group by 1, 2"""


@query("w10_region_covariates", over(_w10_sql(), "regions"))
def w10(s, d):
    return rounded(features.region_covariates(grid(s, d), view(s, d, "regions"), keys=K), 8)


def _w11_sql():
    cols = []
    for w in (1, 3, 6, 12, 24):
        cond = f"filter (s.peak_time >= g.timestamp - interval {w} hour)"
        cols.append(f"count(s.peak_time) {cond} as flare_count_{w}h")
        cols.append(f"coalesce(max(case s.class_category when 'B' then 1 when 'C' then 2 when 'M' then 3 when 'X' then 4 else 0 end) {cond}, 0) as max_flare_class_{w}h")
        cols.append(f"q_8(coalesce((epoch_us(g.timestamp) - epoch_us(max(s.peak_time) {cond})) / 3.6e9, {w})) as hours_since_last_flare_{w}h")
    return f"""select g.series_id, g.timestamp, {', '.join(cols)} from grid g left join flares s on s.series_id = g.series_id
        and s.peak_time >= g.timestamp - interval 24 hour and s.peak_time < g.timestamp group by 1, 2"""


@query("w11_event_covariates", over(_w11_sql(), "flares"))
def w11(s, d):
    return rounded(features.event_covariates(grid(s, d), view(s, d, "flares"), keys=K), 8)


def _w12_sql():
    cols = []
    for w in (24, 48):
        cond = f"filter (s.start_time < g.timestamp + interval {w} hour)"
        rank = "case s.class_category when 'C' then 1 when 'M' then 2 when 'X' then 3 else 0 end"
        cols.append(f"case coalesce(max({rank}) {cond}, 0) when 0 then 'None' when 1 then 'C' when 2 then 'M' else 'X' end as label_{w}h")
        cols.append(f"count(s.start_time) {cond} as num_flares_{w}h")
        cols.append(f"coalesce(max(s.class_magnitude) {cond}, 0) as max_magnitude_{w}h")
    out = f"""select g.series_id, g.timestamp, {', '.join(cols)} from grid g left join flares s on s.series_id = g.series_id
        and s.start_time >= g.timestamp and s.start_time < g.timestamp + interval 48 hour group by 1, 2"""
    seen = lambda w: f"""select series_id, timestamp, string_agg(c, ',' order by t) as flare_classes_{w}h from (
        select g.series_id, g.timestamp, s.class_category as c, min(s.start_time) as t from grid g join flares s on s.series_id = g.series_id
        and s.start_time >= g.timestamp and s.start_time < g.timestamp + interval {w} hour group by 1, 2, 3) x group by 1, 2"""
    return f"""with base as ({out}), a as ({seen(24)}), b as ({seen(48)})
      select base.*, coalesce(a.flare_classes_24h, '') as flare_classes_24h, coalesce(b.flare_classes_48h, '') as flare_classes_48h
      from base left join a using (series_id, timestamp) left join b using (series_id, timestamp)"""


@query("w12_forward_labels", over(_w12_sql(), "flares"))
def w12(s, d):
    return labels.class_labels(grid(s, d), view(s, d, "flares"), keys=K)


@query("w13_survival_labels", over("""select g.series_id, g.timestamp, min(s.start_time) as event_time,
      q_8(coalesce((epoch_us(min(s.start_time)) - epoch_us(g.timestamp)) / 3.6e9, 168)) as duration, case when min(s.start_time) is null then 0 else 1 end as event
    from grid g left join flares s on s.series_id = g.series_id and s.class_category = 'M' and s.start_time > g.timestamp
      and s.start_time <= g.timestamp + interval 168 hour group by 1, 2""", "flares"))
def w13(s, d):
    return rounded(labels.survival_labels(grid(s, d), view(s, d, "flares"), keys=K, target="M"), 8)


@query("j1_window_join", over("""select g.series_id, g.timestamp as grid_time, s.timestamp, s.flux_short, s.flux_long from grid g join flux s
    on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 6 hour and g.timestamp"""))
def j1(s, d):
    g = grid(s, d).withColumnRenamed("timestamp", "grid_time").withColumn("grid_us", micros("grid_time"))
    series = flux(s, d).withColumn("us", micros("timestamp"))
    return window_join(g, series, keys=K, before_us=hours_to_us(6), after_us=0).drop("grid_us", "us")


@query("j2_forward_join", over("""select g.series_id, g.timestamp, s.event_id, s.start_time, s.class_category from grid g join flares s
    on s.series_id = g.series_id and s.start_time >= g.timestamp and s.start_time < g.timestamp + interval 24 hour""", "flares"))
def j2(s, d):
    g = grid(s, d).withColumn("grid_us", micros("timestamp"))
    ev = view(s, d, "flares").select("series_id", "event_id", "start_time", "class_category").withColumn("us", micros("start_time"))
    return window_join(g, ev, keys=K, before_us=0, after_us=hours_to_us(24) - 1).drop("grid_us", "us")


@query("j3_next_event", over("""select g.series_id, g.timestamp, min(s.start_time) as event_time from grid g left join flares s
    on s.series_id = g.series_id and s.start_time > g.timestamp and s.start_time <= g.timestamp + interval 168 hour group by 1, 2""", "flares"))
def j3(s, d):
    return labels.next_event(grid(s, d), view(s, d, "flares"), keys=K)


@query("j4_region_in_force", over("""select g.series_id, g.timestamp, max(s.timestamp) as region_time, arg_max(s.region_number, s.timestamp) as region_number,
      arg_max(s.area, s.timestamp) as area, arg_max(coalesce(s.mcintosh_class, '-'), s.timestamp) as mcintosh_class
    from grid g left join regions s on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 48 hour and g.timestamp group by 1, 2""", "regions"))
def j4(s, d):
    out = features.asof_region(grid(s, d), view(s, d, "regions"), keys=K)
    cls = F.when(F.col("region_time").isNotNull(), F.coalesce("mcintosh_class", F.lit("-")))
    return out.select("series_id", "timestamp", "region_time", "region_number", "area", cls.alias("mcintosh_class"))


@query("j8_label_join", over("""with f as (select g.series_id, g.timestamp, count(s.timestamp) as samples from grid g left join flux s on s.series_id = g.series_id
        and s.timestamp between g.timestamp - interval 24 hour and g.timestamp group by 1, 2),
      l as (select g.series_id, g.timestamp, count(s.start_time) as upcoming from grid g left join flares s on s.series_id = g.series_id
        and s.start_time >= g.timestamp and s.start_time < g.timestamp + interval 24 hour group by 1, 2)
    select f.series_id, f.timestamp, f.samples, l.upcoming from f left join l on l.series_id = f.series_id and l.timestamp = f.timestamp""", "flares"))
def j8(s, d):
    f = features.trailing(grid(s, d), flux(s, d), keys=K, windows=[("w", hours_to_us(24), 0)],
        parts=[features.Part("n", F.lit(1).cast("bigint"), "sum")], finals=[F.coalesce(F.sum("n"), F.lit(0)).alias("samples")])
    lab = labels.class_labels(grid(s, d), view(s, d, "flares"), keys=K, windows=[24])
    return labels.classification_set(f, lab, keys=K, label="label_24h").select("series_id", "timestamp", "samples", F.col("num_flares_24h").alias("upcoming"))


@query("c8_regular_grid", over("select series_id, timestamp from grid"))
def c8(s, d):
    return grid(s, d)


@query("c9_sampled_grid", oracle("""select series_id, timestamp from (select series_id, timestamp, row_number() over (partition by series_id order by timestamp) - 1 as i from flux) x
    where i % 144 = 0""", "flux"))
def c9(s, d):
    return grids.sampled_grid(flux(s, d), keys=K, every=144)


_BEFORE = """(select distinct f.series_id, f.start_time - l.h * interval 1 hour as timestamp from flares f, (values (12), (24), (48)) l(h)
    join (select series_id as sid, date_trunc('day', min(timestamp)) as a, max(timestamp) as b from flux group by 1) c on true
    where c.sid = f.series_id and f.start_time - l.h * interval 1 hour between c.a and c.b)"""


@query("c10_before_events", oracle(f"select * from {_BEFORE} x", "flux", "flares"))
def c10(s, d):
    return grids.before_events(view(s, d, "flares"), grids.coverage_bounds(flux(s, d), keys=K), keys=K).distinct()


@query("u2_grid_union", over(f"select series_id, timestamp from grid union select series_id, timestamp from {_BEFORE} x", "flares"))
def u2(s, d):
    return grids.union_grids(grid(s, d), grids.before_events(view(s, d, "flares"), grids.coverage_bounds(flux(s, d), keys=K), keys=K))


@query("m38_training_grid", oracle(f"""with grid as (select series_id, unnest(generate_series(date_trunc('day', min(timestamp)), max(timestamp), interval 12 hour)) as timestamp
    from flux group by series_id) select series_id, timestamp from grid union select series_id, timestamp from {_BEFORE} x""", "flux", "flares"))
def m38(s, d):
    return grids.training_grid(flux(s, d), view(s, d, "flares"), keys=K)


# --- composites ---------------------------------------------------------------------------


def _joined(*texts):
    """One oracle text of several on the grid, joined; missing numbers become 0."""
    first, *rest = [f"({t}) t{i}" for i, t in enumerate(texts)]
    return f"select * from {first} " + " ".join(f"join {r} using (series_id, timestamp)" for r in rest)


_REGION_PART = over(f"""select g.series_id, g.timestamp, {', '.join(f"max(r.{c}) as {c}" for c in ('size_code', 'shape_code', 'third_code'))},
      q_8(max(r.mc)) as mcintosh_complexity_score, q_8(max(r.mw)) as mount_wilson_complexity_score, q_8(max(r.mw)) as magnetic_complexity_score,
      max(cast(r.area as double)) as region_area, max(cast(r.num_sunspots as double)) as region_num_sunspots
    from (select g.series_id, g.timestamp, max((s.timestamp, s.region_number)) as k from grid g left join regions s
        on s.series_id = g.series_id and s.timestamp between g.timestamp - interval 48 hour and g.timestamp group by 1, 2) g
      left join (select *, {mc_codes()[0]} as size_code, {mc_codes()[1]} as shape_code, {mc_codes()[2]} as third_code, {mc_score()} as mc, {mw_score()} as mw from regions) r
        on r.series_id = g.series_id and (r.timestamp, r.region_number) = g.k group by 1, 2""", "regions")


def _m1_sql():
    parts = [expand_rounding(_REGION_PART), *[ORACLES[n] for n in ("w2_flux_summary", "w4_hardness_ratio", "w3_index_trend", "w5_rate_of_change", "w6_acceleration")]]
    parts += [expand_rounding(over(_w1_sql((6, 12, 24), ("mean", "max", "std")))), ORACLES["w8_weighted_counts"]]
    return f"select series_id, timestamp, coalesce(columns(* exclude (series_id, timestamp)), 0) from ({_joined(*parts)}) x"


_FLUX_14 = ("_mean", "_max", "_min", "_std", "_trend_short", "_trend_long", "_rate_of_change", "_acceleration")


def _features(s, d):
    out = features.build_features(grid(s, d), flux(s, d), view(s, d, "regions"), view(s, d, "flares"), keys=K)
    drop = ["mcintosh_size", "mcintosh_shape", "mcintosh_penumbra", *[f"mount_wilson_has_{w}" for w in ("alpha", "beta", "gamma", "delta")]]
    out = out.drop(*drop).withColumnsRenamed({f"mcintosh_{n}_encoded": f"{c}_code" for n, c in (("size", "size"), ("shape", "shape"), ("penumbra", "third"))})
    fine = [c for c in out.columns if c.startswith("flux_") and c.endswith(_FLUX_14)]
    coarse = [c for c, t in out.dtypes if t == "double" and c not in fine]
    return rounded(rounded(out, 14, fine), 8, coarse)


@query("m1_feature_table", _m1_sql())
def m1(s, d):
    return _features(s, d)


def _m2_sql():
    return _joined(*[ORACLES[n] for n in ("w9_flux_covariates", "w10_region_covariates", "w11_event_covariates")])


def _covariates(s, d):
    out = features.build_covariates(grid(s, d), flux(s, d), view(s, d, "regions"), view(s, d, "flares"), keys=K)
    trends = [c for c in out.columns if "_trend_" in c]
    fine = [c for c in out.columns if c.startswith("flux_") and c not in trends]
    rest = [c for c, t in out.dtypes if t == "double" and c not in trends + fine]
    return rounded(rounded(rounded(out, 11, trends), 14, fine), 8, rest)


@query("m2_covariate_table", _m2_sql())
def m2(s, d):
    return _covariates(s, d)


def _m3_sql():
    return f"select * from ({_m1_sql()}) f join ({ORACLES['w12_forward_labels']}) l using (series_id, timestamp)"


@query("m3_classification_set", _m3_sql())
def m3(s, d):
    lab = labels.class_labels(grid(s, d), view(s, d, "flares"), keys=K)
    return labels.classification_set(_features(s, d), lab, keys=K, label="label_24h")


def _m4_sql():
    return f"select * from ({_m2_sql()}) f join ({ORACLES['w13_survival_labels']}) l using (series_id, timestamp)"


@query("m4_survival_set", _m4_sql())
def m4(s, d):
    lab = rounded(labels.survival_labels(grid(s, d), view(s, d, "flares"), keys=K, target="M"), 8)
    return labels.survival_set(_covariates(s, d), lab, keys=K)
