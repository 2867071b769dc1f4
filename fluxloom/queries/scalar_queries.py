"""Queries of the scalar operators, filters, summaries and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.functions import classes, curves, magnetic, status, timing
from fluxloom.operators import reports
from fluxloom.queries.feature_queries import flux, mc_codes, mc_score, mw_score
from fluxloom.queries.registry import q, query, rounded
from fluxloom.queries.views import oracle, table, view
from fluxloom.sources import feeds, tables

_F = "value * 3e-7"


def _class_case(f):
    return f"case when {f} >= 1e-4 then 'X' when {f} >= 1e-5 then 'M' when {f} >= 1e-6 then 'C' else 'B' end"


def _mag_case(f):
    return f"floor(10 * (case when {f} >= 1e-4 then {f} / 1e-4 when {f} >= 1e-5 then {f} / 1e-5 when {f} >= 1e-6 then {f} / 1e-6 else {f} / 1e-7 end) + 0.5) / 10e0"


_CLASS_TEXT = f"concat({_class_case(_F)}, printf('%.1f', {_mag_case(_F)}))"


@query("c1_classify_flux", f"select event_id, {_class_case(_F)} as letter, {_mag_case(_F)} as magnitude, {_CLASS_TEXT} as label from events")
def c1(s, d):
    f = F.col("value") * 3e-7
    return table(s, d, "events").select(
        "event_id", classes.class_letter(f).alias("letter"), classes.class_magnitude(f).alias("magnitude"), classes.class_label(f).alias("label")
    )


_DIRTY = f"""case event_id % 6 when 0 then '' when 1 then null when 2 then 'invalid' when 3 then lower({_CLASS_TEXT}) else {_CLASS_TEXT} end"""


@query("c2_parse_class", f"""select event_id, case when n is not null then upper(substr(t, 1, 1)) end as letter, n as magnitude
    from (select event_id, t, try_cast(substr(t, 2) as double) as n from (select event_id, {_DIRTY} as t from events) a) b""")
def c2(s, d):
    f = F.col("value") * 3e-7
    text = classes.class_label(f)
    kind = F.pmod("event_id", F.lit(6))
    dirty = F.when(kind == 0, "").when(kind == 1, None).when(kind == 2, "invalid").when(kind == 3, F.lower(text)).otherwise(text)
    letter, magnitude = classes.parsed_class("t")
    return table(s, d, "events").select("event_id", dirty.alias("t")).select("event_id", letter.alias("letter"), magnitude.alias("magnitude"))


_MAG = """case when m is null or m = '' then 'unknown' when contains(lower(m), 'delta') then 'beta-gamma-delta' when contains(lower(m), 'gamma') then 'beta-gamma'
    when contains(lower(m), 'beta') then 'beta' when contains(lower(m), 'alpha') then 'alpha' else m end"""
_POL = "case when contains(lower(coalesce(m, '')), 'beta') or contains(lower(coalesce(m, '')), 'gamma') or contains(lower(coalesce(m, '')), 'delta') then 'mixed' else 'unknown' end"
_REG = "(select *, mount_wilson_class as m from regions)"


@query("c3_magnetic_complexity", oracle(f"select timestamp, {_MAG} as complexity from {_REG} r", "regions"))
def c3(s, d):
    return view(s, d, "regions").select("timestamp", magnetic.magnetic_complexity("mount_wilson_class").alias("complexity"))


@query("c4_polarity", oracle(f"select timestamp, {_POL} as polarity from {_REG} r", "regions"))
def c4(s, d):
    return view(s, d, "regions").select("timestamp", magnetic.polarity("mount_wilson_class").alias("polarity"))


_SZ, _SH, _TH = mc_codes()


@query("c5_sunspot_score", oracle(f"""select timestamp, case when length(upper(trim(mcintosh_class))) >= 1 then substr(upper(trim(mcintosh_class)), 1, 1) end as size_letter,
    {_SZ} as size_code, {_SH} as shape_code, {_TH} as third_code, q_8({mc_score()}) as score from regions""", "regions"))
def c5(s, d):
    a, b, c = magnetic.sunspot_codes("mcintosh_class")
    size, _, _ = magnetic.sunspot_letters("mcintosh_class")
    return view(s, d, "regions").select(
        "timestamp", size.alias("size_letter"), a.alias("size_code"), b.alias("shape_code"), c.alias("third_code"), q(magnetic.sunspot_score("mcintosh_class"), 8).alias("score")
    )


@query("c6_magnetic_score", oracle(f"""select timestamp, {', '.join(f"cast(contains(lower(trim(coalesce(mount_wilson_class, ''))), '{w}') as int) as has_{w}" for w in ('alpha', 'beta', 'gamma', 'delta'))},
    q_8({mw_score()}) as score from regions""", "regions"))
def c6(s, d):
    flags = magnetic.magnetic_flags("mount_wilson_class")
    return view(s, d, "regions").select("timestamp", *[f.alias(f"has_{w}") for w, f in flags.items()], q(magnetic.magnetic_score("mount_wilson_class"), 8).alias("score"))


@query("c7_parse_time", """select event_id, case event_id % 5 when 0 then date_trunc('minute', ts) when 1 then date_trunc('second', ts) when 2 then date_trunc('minute', ts) - interval 2 hour
      when 3 then null else null end as parsed from events""")
def c7(s, d):
    kind = F.pmod("event_id", F.lit(5))
    fmt = lambda p: F.date_format("ts", p)
    text = (
        F.when(kind == 0, fmt("yyyy-MM-dd'T'HH:mm'Z'"))
        .when(kind == 1, fmt("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 2, fmt("yyyy-MM-dd'T'HH:mm'+02:00'"))
        .when(kind == 3, "invalid")
        .otherwise("")
    )
    return table(s, d, "events").select("event_id", timing.parse_utc(text).alias("parsed"))


@query("c11_freshness", """select user_id, max(ts) as latest, q_8((epoch_us(n) - epoch_us(max(ts))) / 3.6e9) as age_hours,
    case when (epoch_us(n) - epoch_us(max(ts))) / 3.6e9 < 24 then 'fresh' when (epoch_us(n) - epoch_us(max(ts))) / 3.6e9 < 48 then 'stale' else 'outdated' end as status
    from events, (select max(ts) as n from events) x group by user_id, n""")
def c11(s, d):
    ev = table(s, d, "events")
    newest = ev.groupBy("user_id").agg(F.max("ts").alias("latest"))
    now = ev.agg(F.max("ts").alias("now"))  # one row
    age, word = status.freshness(F.col("latest"), F.col("now"))
    return newest.join(F.broadcast(now), F.lit(True)).select("user_id", "latest", q(age, 8).alias("age_hours"), word.alias("status"))


_CURVE_B = [0, 6, 12, 24, 48, 72, 96, 120, 168]


@query("c12_bucket_probabilities", f"""select event_id, {', '.join(f'q_8(least(1, greatest(0, exp(-{a} / l) - exp(-{b} / l)))) as p_{a}_{b}' for a, b in zip(_CURVE_B, _CURVE_B[1:]))}
    from (select event_id, 5e0 + value as l from events) e""")
def c12(s, d):
    hours = F.array(*[F.lit(float(h)) for h in _CURVE_B])
    curve = F.transform(hours, lambda h: F.struct(h.alias("t"), F.exp(-h / (F.lit(5.0) + F.col("value"))).alias("s")))
    ev = table(s, d, "events").select("event_id", curves.bucket_probabilities(curve).alias("m"))
    return ev.select("event_id", *[q(F.col("m")[f"{a}h-{b}h"], 8).alias(f"p_{a}_{b}") for a, b in zip(_CURVE_B, _CURVE_B[1:])])


@query("c13_json_payload", """select event_id, cast(json_extract(props, '$.k') as bigint) as k, concat('{"k":', json_extract(props, '$.k'), ',"kind":"', event_type, '"}') as encoded from events""")
def c13(s, d):
    ev = table(s, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return ev.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("p.k").alias("k"), F.col("event_type").alias("kind"))).alias("encoded"))


def prob_map():
    return F.create_map(F.lit("None"), F.col("p_none"), F.lit("C"), F.col("p_c"), F.lit("M"), F.col("p_m"), F.lit("X"), F.col("p_x"))


@query("c14_risk_level", oracle("select id, case when p_x > 0.20 then 'EXTREME' when p_x > 0.05 or p_m > 0.70 then 'HIGH' when p_m > 0.30 then 'MEDIUM' else 'LOW' end as risk from class_probs", "class_probs"))
def c14(s, d):
    return view(s, d, "class_probs").select("id", classes.risk_level(prob_map()).alias("risk"))


@query("c15_confidence", oracle("""select id, band, q_6(greatest(10, least(100, score))) as score from (
    select id, case when a >= 0.7 and a - b >= 0.3 then 'high' when a >= 0.5 or a - b >= 0.2 then 'normal' else 'low' end as band,
      case when a >= 0.7 and a - b >= 0.3 then least(100, 100 * a + 50 * (a - b)) when a >= 0.5 or a - b >= 0.2 then least(90, 100 * a + 30 * (a - b)) else greatest(20, 100 * a) end as score
    from (select id, l[1] as a, l[2] as b from (select id, list_reverse_sort([p_none, p_c, p_m, p_x]) as l from class_probs) x) y) z""", "class_probs"))
def c15(s, d):
    band, score = classes.confidence(prob_map())
    return view(s, d, "class_probs").select("id", band.alias("band"), q(score, 6).alias("score"))


@query("c16_display_level", oracle("""select id, pick, case when pick = 'None' then 'None' when pick = 'X' then 'Extreme'
      when pick = 'M' then case when best >= 0.5 then 'Strong' when best >= 0.25 then 'Moderate' else 'Minor' end
      else case when best >= 0.5 then 'Moderate' else 'Minor' end end as level
    from (select id, best, case when best < 0.05 then 'None' when p_c = best then 'C' when p_m = best then 'M' else 'X' end as pick
      from (select *, greatest(p_c, p_m, p_x) as best from class_probs) a) b""", "class_probs"))
def c16(s, d):
    pick, level = classes.display_level(prob_map())
    return view(s, d, "class_probs").select("id", pick.alias("pick"), level.alias("level"))


_RUNS = """(select event_id // 5 as run_id, case event_id % 5 when 0 then 'xray_flux' when 1 then 'solar_regions' when 2 then 'magnetogram' when 3 then 'flare_events' else 'donki_flares' end as source_name,
    case when value > 60 then 'failed' when event_type = 'signup' and event_id % 5 = 4 then 'skipped' else 'success' end as status from events)"""


@query("c17_load_status", f"""select run_id, n as required_total, ok as required_success, opt as optional_success,
      case when n = 0 then 'failed' when ok = n then 'success' when ok > 0 then 'partial' when opt > 0 then 'partial' else 'failed' end as overall_status
    from (select run_id, count(*) filter (source_name <> 'donki_flares') as n, count(*) filter (source_name <> 'donki_flares' and status = 'success') as ok,
      count(*) filter (source_name = 'donki_flares' and status = 'success') as opt from {_RUNS} r group by run_id) x""")
def c17(s, d):
    kind = F.pmod("event_id", F.lit(5))
    name = F.when(kind == 0, "xray_flux").when(kind == 1, "solar_regions").when(kind == 2, "magnetogram").when(kind == 3, "flare_events").otherwise("donki_flares")
    state = F.when(F.col("value") > 60, "failed").when((F.col("event_type") == "signup") & (kind == 4), "skipped").otherwise("success")
    runs = table(s, d, "events").select(F.expr("event_id div 5").alias("run_id"), name.alias("source_name"), state.alias("status"))
    return status.load_status(runs)


# --- filters ------------------------------------------------------------------------------

T0, T1 = "2024-01-05 00:00:00", "2024-01-25 00:00:00"


@query("p1_events_at_least", oracle(f"""select event_id, start_time, class_category, active_region from flares where start_time between timestamp '{T0}' and timestamp '{T1}'
    and class_category in ('M', 'X') and active_region = 7""", "flares"))
def p1(s, d):
    out = reports.events_at_least(view(s, d, "flares"), start=T0, end=T1, min_class="M", region=7)
    return out.select("event_id", "start_time", "class_category", "active_region")


@query("p2_events_by_letter", oracle(f"""select event_id, peak_time, t as flare_class from (select *, concat(case when event_id % 9 = 0 then 'q' else lower(class_category) end, printf('%.1f', class_magnitude)) as t from flares) x
    where peak_time between timestamp '{T0}' and timestamp '{T1}' and substr(t, 1, 1) in ('c', 'm', 'x')""", "flares"))
def p2(s, d):
    letter = F.when(F.pmod("event_id", F.lit(9)) == 0, "q").otherwise(F.lower("class_category"))
    ev = view(s, d, "flares").withColumn("flare_class", F.concat(letter, F.format_string("%.1f", "class_magnitude")))
    return reports.events_at_least(ev, start=T0, end=T1, min_class="C", by="peak").select("event_id", "peak_time", "flare_class")


@query("p3_valid_flux", oracle("select series_id, timestamp, flux_short, flux_long from flux where flux_short > 0 and flux_long > 0", "flux"))
def p3(s, d):
    return feeds.valid_flux(view(s, d, "flux")).select("series_id", "timestamp", "flux_short", "flux_long")


def prediction_log(s, d):
    v = view(s, d, "class_probs")
    kind = F.when(F.col("kind") == "purchase", "survival").otherwise("classification")
    rows = v.select(
        "id",
        F.col("timestamp").alias("observation_timestamp"),
        kind.alias("prediction_type"),
        F.lit("logistic").alias("model_type"),
        F.lit(24).alias("window_hours"),
        predicted().alias("predicted_class"),
        prob_map().alias("class_probabilities"),
        "actual",
        "timestamp",
    )
    return rows


def predicted():
    best = F.greatest("p_none", "p_c", "p_m", "p_x")
    return F.when(F.col("p_none") == best, "None").when(F.col("p_c") == best, "C").when(F.col("p_m") == best, "M").otherwise("X")


_PRED_CASE = "case when p_none = greatest(p_none, p_c, p_m, p_x) then 'None' when p_c = greatest(p_none, p_c, p_m, p_x) then 'C' when p_m = greatest(p_none, p_c, p_m, p_x) then 'M' else 'X' end"


@query("p4_list_predictions", oracle(f"""select id, timestamp, prediction_type, p_m from (select *, case when kind = 'purchase' then 'survival' else 'classification' end as prediction_type from class_probs) x
    where timestamp between timestamp '{T0}' and timestamp '{T1}' and prediction_type = 'classification' order by timestamp desc limit 50""", "class_probs"))
def p4(s, d):
    log = prediction_log(s, d).select("id", "timestamp", "prediction_type", F.to_json("class_probabilities").alias("class_probabilities"))
    out = tables.list_predictions(log, start=T0, end=T1, kind="classification", limit=50, ts="timestamp")
    return out.select("id", "timestamp", "prediction_type", F.col("class_probabilities")["M"].alias("p_m"))


# --- summaries ----------------------------------------------------------------------------


@query("a1_class_counts", oracle(f"select class_category, count(*) as n from flares where start_time between timestamp '{T0}' and timestamp '{T1}' group by 1", "flares"))
def a1(s, d):
    return reports.class_counts(view(s, d, "flares"), start=T0, end=T1)


@query("a2_coverage", oracle("""select 'flux' as name, count(*) as n, min(timestamp) as first_time, max(timestamp) as last_time from flux
    union all select c.name, count(f.event_id), min(start_time), max(start_time) from (values ('C'), ('M'), ('X')) c(name) left join flares f on f.class_category = c.name group by 1""", "flux", "flares"))
def a2(s, d):
    return reports.coverage(view(s, d, "flux"), view(s, d, "flares"))


@query("a3_sufficiency", oracle("""select c as n_c, m as n_m, x as n_x, total, q_8(d) as period_days, c >= 200 and m >= 50 and x >= 10 as sufficient from (
    select count(*) filter (class_category = 'C') as c, count(*) filter (class_category = 'M') as m, count(*) filter (class_category = 'X') as x, count(*) as total,
      floor((epoch_us(max(start_time)) - epoch_us(min(start_time))) / 1e6) / 86400 as d from flares) y""", "flares"))
def a3(s, d):
    return rounded(reports.sufficiency(view(s, d, "flares")), 8)


@query("a4_latest", oracle("""select 'xray_flux' as table_name, max(timestamp) as latest, count(*) as n from flux union all select 'flare_events', max(peak_time), count(*) from flares
    union all select 'solar_regions', max(timestamp), count(*) from regions""", "flux", "flares", "regions"))
def a4(s, d):
    return reports.latest({"xray_flux": (view(s, d, "flux"), "timestamp"), "flare_events": (view(s, d, "flares"), "peak_time"), "solar_regions": (view(s, d, "regions"), "timestamp")})


@query("a5_source_breakdown", oracle("select class_category, count(*) as n_all, count(*) filter (source = 'nasa_donki') as n_source from flares group by rollup (class_category)", "flares"))
def a5(s, d):
    return reports.source_breakdown(view(s, d, "flares"))


@query("a6_label_distribution", oracle(f"""select 'actual' as label_column, actual as label, count(*) as n from class_probs group by 2
    union all select 'predicted', {_PRED_CASE}, count(*) from class_probs group by 2""", "class_probs"))
def a6(s, d):
    return reports.label_distribution(view(s, d, "class_probs").withColumn("predicted", predicted()), ["actual", "predicted"])


@query("a7_event_rate", oracle("select q_8(avg(event)) as event_rate from survival", "survival"))
def a7(s, d):
    return rounded(reports.event_rate(view(s, d, "survival")), 8)


@query("a8_missing_profile", oracle("""select '*' as column_name, count(*) - count(flux_short) + count(*) - count(flux_long) as missing, q_8((count(*) - count(flux_short) + count(*) - count(flux_long)) / (2e0 * count(*))) as fraction from flux
    union all select 'flux_short', count(*) - count(flux_short), q_8((count(*) - count(flux_short)) / (1e0 * count(*))) from flux
    union all select 'flux_long', count(*) - count(flux_long), q_8((count(*) - count(flux_long)) / (1e0 * count(*))) from flux""", "flux"))
def a8(s, d):
    return rounded(reports.missing_profile(view(s, d, "flux"), ["flux_short", "flux_long"]), 8)


@query("a9_probability_summary", oracle(" union all ".join(f"select '{n}' as class_name, q_8(avg({c})) as mean_p, q_8(stddev_pop({c})) as std_p, q_8(min({c})) as min_p, q_8(max({c})) as max_p from class_probs"
    for n, c in (("None", "p_none"), ("C", "p_c"), ("M", "p_m"), ("X", "p_x"))), "class_probs"))
def a9(s, d):
    return rounded(reports.probability_summary(view(s, d, "class_probs"), {"None": "p_none", "C": "p_c", "M": "p_m", "X": "p_x"}), 8)


NOW = "timestamp '2024-01-30 00:00:00'"


@query("a10_last_by_class", oracle(f"""select max(start_time) filter (class_category = 'M') as last_m, max(start_time) filter (class_category = 'X') as last_x from flares
    where start_time between {NOW} - interval 90 day and {NOW}""", "flares"))
def a10(s, d):
    return reports.last_by_class(view(s, d, "flares"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))


@query("a10_recent_events", oracle(f"""select event_id, start_time, class_category, count(*) over (partition by class_category) as class_total from flares
    where class_category in ('C', 'M', 'X') and start_time between {NOW} - interval 7 day and {NOW}""", "flares"))
def a10b(s, d):
    out = reports.recent_events(view(s, d, "flares"), F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    return out.select("event_id", "start_time", "class_category", "class_total")


def outcome_log(s, d):
    log = prediction_log(s, d)
    done = F.when(F.pmod("id", F.lit(3)) != 0, F.col("timestamp"))
    return log.withColumn("outcome_recorded_at", done).withColumn("actual_flare_class", F.when(F.col("actual") != "None", F.col("actual")))


@query("a11_outcome_metrics", oracle(f"""select count(*) as total_predictions, count(*) filter (id % 3 <> 0) as with_outcomes, count(*) filter (id % 3 <> 0 and kind <> 'purchase') as classification_completed,
    count(*) filter (id % 3 <> 0 and kind = 'purchase') as survival_completed,
    q_8(count(*) filter (id % 3 <> 0 and kind <> 'purchase' and actual = {_PRED_CASE}) / cast(count(*) filter (id % 3 <> 0 and kind <> 'purchase') as double)) as accuracy from class_probs""", "class_probs"))
def a11(s, d):
    return rounded(reports.outcome_metrics(outcome_log(s, d)), 8)


@query("a12_pipeline_status", """select * from (select max(ts) as last_load, arg_max(event_type, ts) as last_source from events where value <= 60) a, (select count(*) as total_predictions from events) b,
    (select max(o_orderdate) as last_validation, arg_max(case when o_orderstatus = 'F' then 'fail' else 'pass' end, (o_orderdate, o_orderkey)) as validation_status,
       arg_max(o_orderstatus = 'F', (o_orderdate, o_orderkey)) as guardrail_triggered from orders) c""")
def a12(s, d):
    ev = table(s, d, "events")
    loads = ev.select(F.col("ts").alias("run_timestamp"), F.col("event_type").alias("source_name"), F.when(F.col("value") <= 60, "success").otherwise("failed").alias("status"))
    orders = table(s, d, "orders")
    checks = orders.select(
        F.struct("o_orderdate", "o_orderkey").alias("run_timestamp"),
        F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass").alias("status"),
        (F.col("o_orderstatus") == "F").alias("guardrail_triggered"),
    )
    return reports.pipeline_status(loads, ev, checks).withColumn("last_validation", F.col("last_validation.o_orderdate"))


# --- rankings -----------------------------------------------------------------------------


@query("o1_newest_rows", "select event_id, ts, event_type from events order by ts desc limit 100")
def o1(s, d):
    return tables.list_predictions(table(s, d, "events").select("event_id", "ts", "event_type"), limit=500, ts="ts")


@query("o2_ranked_classes", oracle("""select id, class_name, floor(p * 1e4 + 0.5) / 100e0 as percent, row_number() over (partition by id order by p desc, class_name) as rank
    from (select id, unnest(['None', 'C', 'M', 'X']) as class_name, unnest([p_none, p_c, p_m, p_x]) as p from class_probs) x""", "class_probs"))
def o2(s, d):
    return reports.ranked_classes(view(s, d, "class_probs").select("id", prob_map().alias("m")), "m", ["id"])


@query("o3_ordered_buckets", """select bucket, bucket_start, n from (select concat(a, 'h-', a + 6, 'h') as bucket, a as bucket_start, count(*) as n from (select cast(floor(value / 6) * 6 as int) as a from events) x group by a) y""")
def o3(s, d):
    a = F.floor(F.col("value") / 6) * 6
    counted = table(s, d, "events").groupBy(a.cast("int").alias("a")).agg(F.count("*").alias("n"))
    labelled = counted.select(F.concat(F.col("a"), F.lit("h-"), F.col("a") + 6, F.lit("h")).alias("bucket"), "n")
    return reports.ordered_buckets(labelled)


@query("o4_top_contributions", """select l_orderkey, l_linenumber, feature, q_8(value) as value, rank from (
    select *, row_number() over (partition by rid order by abs(value) desc, feature) as rank from (
      select row_number() over () as rid, l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax', 'price']) as feature,
        unnest([cast(l_quantity as double) - 25, 100 * cast(l_discount as double) - 5, 100 * cast(l_tax as double) - 4, cast(l_extendedprice as double) / 1e4 - 3]) as value from lineitem) x) y where rank <= 3""")
def o4(s, d):
    li = table(s, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_quantity").cast("double") - 25).alias("quantity"),
        (100 * F.col("l_discount").cast("double") - 5).alias("discount"),
        (100 * F.col("l_tax").cast("double") - 4).alias("tax"),
        (F.col("l_extendedprice").cast("double") / 1e4 - 3).alias("price"),
    )
    return rounded(reports.top_contributions(li, ["quantity", "discount", "tax", "price"], ["l_orderkey", "l_linenumber"], 3), 8)


@query("o5_likely_bucket", """select event_id, case when a >= greatest(b, c) then '0h-6h' when b >= c then '6h-24h' else '24h-168h' end as bucket, q_8(greatest(a, b, c)) as p,
    case when value / 40 > 1.5 then 'high' when value / 40 > 1.0 then 'moderate' else 'low' end as band
    from (select event_id, value, 1 - exp(-6 / l) as a, exp(-6 / l) - exp(-24 / l) as b, exp(-24 / l) - exp(-168 / l) as c from (select event_id, value, 2e0 + value / 2 as l from events) e) x""")
def o5(s, d):
    life = F.lit(2.0) + F.col("value") / 2
    curve = F.transform(F.array(*[F.lit(float(h)) for h in (0, 6, 24, 168)]), lambda h: F.struct(h.alias("t"), F.exp(-h / life).alias("s")))
    bucket, p = reports.likely_bucket(F.col("m"))
    ev = table(s, d, "events").select("event_id", "value", curves.bucket_probabilities(curve, (0, 6, 24, 168)).alias("m"))
    return ev.select("event_id", bucket.alias("bucket"), q(p, 8).alias("p"), reports.hazard_band(F.col("value") / 40).alias("band"))


@query("j11_probability_delta", oracle("""with a as (select kind, actual as class_name, avg(p_m) as p from class_probs where timestamp < timestamp '2024-01-15' group by 1, 2),
      b as (select kind, actual as class_name, avg(p_m) as p from class_probs where timestamp >= timestamp '2024-01-15' and (kind <> 'error' or actual <> 'X') group by 1, 2)
    select kind, class_name, q_8(p_base) as p_base, q_8(p_scenario) as p_scenario, q_8(coalesce(p_scenario, 0) - coalesce(p_base, 0)) as delta,
      case when abs(coalesce(p_scenario, 0) - coalesce(p_base, 0)) < 0.001 then 'flat' when coalesce(p_scenario, 0) > coalesce(p_base, 0) then 'up' else 'down' end as direction
    from (select kind, class_name, a.p as p_base, b.p as p_scenario from a full join b using (kind, class_name)) x""", "class_probs"))
def j11(s, d):
    v = view(s, d, "class_probs").withColumnRenamed("actual", "class_name")
    early = F.col("timestamp") < F.expr("timestamp_ntz'2024-01-15'")
    mean = lambda df: df.groupBy("kind", "class_name").agg(F.avg("p_m").alias("p"))
    later = v.where(~early & ((F.col("kind") != "error") | (F.col("class_name") != "X")))
    return rounded(reports.probability_delta(mean(v.where(early)), mean(later), on=["kind", "class_name"]), 8)


@query("w18_curve_checks", """select event_id, q_8(1 - e) as curve_range, q_8(greatest(1 - a, a - b, b - e)) as max_drop, q_8(b) as min_before_end
    from (select event_id, exp(-6 / l) as a, exp(-48 / l) as b, exp(-168 / l) as e from (select event_id, 2e0 + value as l from events) x) y""")
def w18(s, d):
    life = F.lit(2.0) + F.col("value")
    values = F.array(*[F.exp(-F.lit(float(h)) / life) for h in (0, 6, 48, 168)])
    return rounded(table(s, d, "events").select("event_id", *[c.alias(n) for n, c in curves.curve_checks(values).items()]), 8)
