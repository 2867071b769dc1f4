"""Queries of models, scoring runs and streams."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import functions as F

from fluxloom.functions.curves import bucket_labels
from fluxloom.functions.timing import micros
from fluxloom.operators import classify, features, labels, model_store, monitor, scoring, survival
from fluxloom.operators.prep import stratified_split
from fluxloom.plans.ordering import beside, range_chunks
from fluxloom.queries.feature_queries import K, flux, grid
from fluxloom.queries.model_queries import DIMENSIONS, vectors
from fluxloom.queries.registry import q, query, rounded
from fluxloom.queries.views import oracle, table, view
from fluxloom.session import durable, staging_path
from fluxloom.streaming import live

XS = [f"x{i}" for i in range(DIMENSIONS)]


def _train(s, d):
    return durable(vectors(s, d).withColumn("label", F.concat(F.lit("c"), F.col("label"))))


def _split(s, d):
    both = durable(stratified_split(_train(s, d), "label", "id"))
    return both.where("not is_test"), both.where("is_test")


# --- classification -----------------------------------------------------------------------


@query("m15_logistic")
def m15(s, d):
    df = _train(s, d)
    scores = classify.cross_validate(df, "label", "id", XS, classify.fitter("logistic", weighted=True))
    model = classify.fitter("logistic", weighted=True)(df, "label", XS)
    right = model.probabilities(df).agg(F.avg((classify.predicted_class(model) == F.col("label")).cast("double")).alias("train_accuracy"))
    return right.withColumn("cv_mean", F.lit(sum(scores) / len(scores))).withColumn("folds", F.lit(len(scores)))


_CLASS = "concat('c', case when label % 10 < 5 then 0 when label % 10 < 7 then 1 when label % 10 < 9 then 2 else 3 end)"


@query("m15_logistic_slopes", f"select distinct {_CLASS} as class_name, true as at_minimum from embeddings")
def m15_slopes(s, d):
    """Whether the penalised mean loss has no slope left at the fitted weights, per class."""
    df = _train(s, d)
    model = classify.fit_logistic(df, "label", XS)
    n, weights = df.count(), model.parts[0].coefficientMatrix.toArray()
    scored = model.probabilities(df)
    out = None
    for i, c in enumerate(model.classes):
        error = F.get("_p", i) - (F.col("label") == c).cast("double")
        slopes = [F.abs(F.avg(error * F.col(x)) + F.lit(float(weights[i, j]) / n)) for j, x in enumerate(XS)] + [F.abs(F.avg(error))]
        part = scored.agg(F.lit(c).alias("class_name"), (F.greatest(*slopes) < 1e-3).alias("at_minimum"))
        out = part if out is None else out.unionByName(part)
    return out


@query("m16_boosted_classifier")
def m16(s, d):
    df = _train(s, d)
    model = classify.fit_gbt(df, "label", XS)
    return model.probabilities(df).agg(F.avg((classify.predicted_class(model) == F.col("label")).cast("double")).alias("train_accuracy"), F.count("*").alias("n"))


@query("m17_train_grid")
def m17(s, d):
    df = _train(s, d).withColumnRenamed("label", "label_24h").withColumn("label_48h", F.when(F.col("label_24h").isin("c0", "c1"), "low").otherwise("high"))
    return classify.train_classifiers(df, ["label_24h", "label_48h"], "id", XS)[1]


@query("m18_calibration")
def m18(s, d):
    train, test = _split(s, d)
    fit = classify.fitter("logistic")
    model = classify.calibrate(fit(train, "label", XS), train, "label", "id", fit)
    return model.probabilities(test).select("id", "label", F.posexplode("_p").alias("class_no", "p"))


@query("m18_calibration_facts", """select class_no, true as rising, true as in_range from (select unnest(range(4)) as class_no) x""")
def m18_facts(s, d):
    """Per class: whether calibrated probabilities never fall as the raw ones rise, before they are normalised, and lie in 0..1."""
    train, test = _split(s, d)
    fit = classify.fitter("logistic")
    model = fit(train, "label", XS)
    maps = classify.calibrate(model, train, "label", "id", fit).calibration
    raw = model.raw_probabilities(test).select(*[F.struct(F.get("_p", i).alias("raw"), classify._mapped(F.get("_p", i), m).alias("p")).alias(f"c{i}") for i, m in enumerate(maps)])
    out = None
    for i in range(len(maps)):
        rows = beside(range_chunks(raw.select(f"c{i}.*"), ["raw", "p"]), F.col("p"), name="before", after=False)
        rises = F.coalesce(F.col("p") >= F.col("before") - 1e-12, F.lit(True))
        part = rows.agg(F.lit(i).cast("bigint").alias("class_no"), F.bool_and(rises).alias("rising"), F.bool_and(F.col("p").between(0, 1)).alias("in_range"))
        out = part if out is None else out.unionByName(part)
    return out


@query("m23_evaluation")
def m23(s, d):
    train, test = _split(s, d)
    fit = classify.fitter("logistic")
    model = fit(train, "label", XS)
    better = classify.calibrate(model, train, "label", "id", fit, method="sigmoid")
    return classify.evaluate(model, test, "label", "before").unionByName(classify.evaluate(better, test, "label", "after"))


@query("m24_score_classes")
def m24(s, d):
    df = _train(s, d)
    model = classify.fit_logistic(df, "label", XS)
    return classify.score_classes(model, df, ["id"], window_hours=24)


@query("m24_score_facts", "select vec_id as id, 24 as window_hours, 'logistic' as model_type, true as sums_to_one, true as picks_the_largest from embeddings")
def m24_facts(s, d):
    """Whether every row's probabilities sum to one and its class is the likeliest."""
    df = _train(s, d)
    scored = classify.score_classes(classify.fit_logistic(df, "label", XS), df, ["id"], window_hours=24)
    values = F.map_values("class_probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return scored.select("id", "window_hours", "model_type", (F.abs(total - 1) < 1e-9).alias("sums_to_one"), (F.col("class_probabilities")[F.col("predicted_class")] == F.array_max(values)).alias("picks_the_largest"))


@query("m33_save_and_load")
def m33(s, d):
    df = _train(s, d)
    path = staging_path(s, "model")
    classify.fit_logistic(df, "label", XS).save(path, s)
    return classify.score_classes(classify.ClassModel.load(path, s), df, ["id"], window_hours=24)


def _stored(s, folder, name, model):
    """The model after it was stored and loaded."""
    model_store.save_model(s, folder, name, model)
    return model_store.load_model(s, folder, name)


@query("m33_model_store", oracle("""select kind, n, true as same from (select 'logistic' as kind, count(*) as n from embeddings union all select 'gbt', count(*) from embeddings union all select 'calibrated', count(*) from embeddings
    union all select 'cox', count(*) from survival union all select 'boosted survival', count(*) from survival) x""", "survival"))
def m33_store(s, d):
    """Models of every kind score all rows alike before and after they are stored."""
    df, rows, folder = _train(s, d), durable(_survival(s, d)), staging_path(s, "models")
    fit = classify.fitter("logistic")
    logistic = fit(df, "label", XS)
    models = {"logistic": logistic, "gbt": classify.fit_gbt(df, "label", XS, trees=5), "calibrated": classify.calibrate(logistic, df, "label", "id", fit)}
    out = None
    for kind, model in models.items():
        again = _stored(s, folder, kind, model)
        both = model.probabilities(df).select("id", F.col("_p").alias("a")).join(again.probabilities(df).select("id", F.col("_p").alias("b")), "id")
        far = F.array_max(F.zip_with("a", "b", lambda a, b: F.abs(a - b)))
        part = both.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), (F.max(far) < 1e-9).alias("same"))
        out = part if out is None else out.unionByName(part)
    covariates = ["x0", "x1", "x2"]
    for kind, model in (("cox", survival.fit_cox(rows, covariates)), ("boosted survival", survival.fit_boosted(rows, covariates, trees=10))):
        again = _stored(s, folder, kind, model)
        both = model.hazard(rows, "a").select("id", "a").join(again.hazard(rows, "b").select("id", "b"), "id")
        out = out.unionByName(both.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), (F.max(F.abs(F.col("a") - F.col("b"))) < 1e-9).alias("same")))
    return out


@query("o6_feature_importance")
def o6(s, d):
    return classify.fit_gbt(_train(s, d), "label", XS).importances(s)


@query("o6_importance_facts", "select cast(max(len(embedding)) as int) as features, true as sums_to_one, true as descending from embeddings")
def o6_facts(s, d):
    """Whether the shares of all features sum to one and come in order."""
    df = _train(s, d)
    model = classify.fit_gbt(df.withColumn("label", F.when(F.col("label") == "c0", "low").otherwise("high")), "label", XS)
    shares = [r["importance"] for r in model.importances(s).collect()]  # one row per feature
    facts = [(len(shares), abs(sum(shares) - 1) < 1e-9, shares == sorted(shares, reverse=True))]
    return s.createDataFrame(facts, "features int, sums_to_one boolean, descending boolean")


@query("m34_permutation_importance")
def m34b(s, d):
    df = _train(s, d)
    return classify.permutation_importance(classify.fit_logistic(df, "label", XS), df, "label", "id")


# --- survival -----------------------------------------------------------------------------

# A fixed model, so that scoring has an oracle: names, means, coefficients, hourly baseline.
FIXED = survival.CoxModel(
    ["x0", "x1", "x2"], [3.0, 5.0, 5.5], [0.1, -0.05, 0.2],
    [(float(h), float(h), 0.004 * h, float(h + 1), 0.004 * (h + 1)) for h in range(survival.HORIZON + 1)],
)
_RISK = "exp(0.1 * (x0 - 3) - 0.05 * (x1 - 5) + 0.2 * (x2 - 5.5))"


def _survival(s, d):
    return view(s, d, "survival")


def _survival_rows(s, d, hours=6):
    """Covariates of every lookback and survival labels of every grid row (class M)."""
    g = grid(s, d, hours)
    cov = features.build_covariates(g, flux(s, d), view(s, d, "regions"), view(s, d, "flares"), keys=K)
    lab = labels.survival_labels(g, view(s, d, "flares"), keys=K, target="M")
    return durable(labels.survival_set(cov, lab, keys=K))


def _covariates_of(rows):
    return [c for c in survival.covariate_columns(rows) if c not in K]


@query("m25_cox_fit")
def m25(s, d):
    rows = _survival_rows(s, d)
    model = survival.fit_cox(rows, _covariates_of(rows))
    fitted = [(c, float(b), float(m), model.converged) for c, b, m in zip(model.columns, model.beta, model.means)]
    return s.createDataFrame(fitted, "covariate string, beta double, mean double, converged boolean")


@query("m26_cox_curve", oracle(f"""select id, {', '.join(f"q_8(exp(-{0.004 * h!r} * {_RISK})) as s_{h}" for h in (0, 6, 24, 72, 168))} from survival""", "survival"))
def m26(s, d):
    out = FIXED.curve(_survival(s, d))
    return out.select("id", *[q(F.get("curve", h)["s"], 8).alias(f"s_{h}") for h in (0, 6, 24, 72, 168)])


@query("m27_partial_hazard", oracle(f"select id, q_8({_RISK}) as hazard_score from survival", "survival"))
def m27(s, d):
    return rounded(FIXED.hazard(_survival(s, d)).select("id", "hazard_score"), 8)


@query("m28_boosting_target", oracle("""select id, q_8(-ln(case when event = 1 then duration else (select max(duration) from survival) end + 1e-6)) as target from survival""", "survival"))
def m28a(s, d):
    return survival.boosting_target(_survival(s, d)).select("id", q("_target", 8).alias("target"))


@query("m28_boosted_survival")
def m28(s, d):
    rows = _survival_rows(s, d)
    return survival.fit_boosted(rows, _covariates_of(rows)).hazard(rows).select(*K, "timestamp", "hazard_score")


@query("m29_exponential_curve", oracle(f"""with h as (select id, ln({_RISK}) as h from survival), t as (select max(abs(h)) as top from h)
    select id, {', '.join(f"q_8(least(1, greatest(0, exp(-h / top * {k})))) as s_{k}" for k in (0, 1, 24, 168))} from h, t""", "survival"))
def m29(s, d):
    df = FIXED.hazard(_survival(s, d), "_r").select("id", F.log("_r").alias("h"))
    out = survival.exponential_curve(df, "h", "curve")
    return out.select("id", *[q(F.get("curve", k)["s"], 8).alias(f"s_{k}") for k in (0, 1, 24, 168)])


@query("m31_survival_models")
def m31(s, d):
    rows = _survival_rows(s, d)
    return survival.train_survival(rows, ["timestamp", *K], _covariates_of(rows))[1]


@query("m32_score_survival", oracle(f"""with c as (select id, {_RISK} as r from survival) select id, q_8(r) as hazard_score, {', '.join(
    f"q_8(exp(-{0.004 * a!r} * r) - exp(-{0.004 * b!r} * r)) as p_{a}_{b}" for a, b in ((0, 6), (6, 12), (12, 24), (24, 48), (48, 72), (72, 96), (96, 120), (120, 168)))} from c""", "survival"))
def m32(s, d):
    out = survival.score_survival(FIXED, _survival(s, d), ["id"])
    dist = [q(F.col("probability_distribution")[b], 8).alias("p_" + b.replace("h", "").replace("-", "_")) for b in bucket_labels()]
    return out.select("id", q("hazard_score", 8).alias("hazard_score"), *dist)


@query("m34_attribution", oracle("""select id, feature, q_8(value) as value, rank from (select *, row_number() over (partition by id order by abs(value) desc, feature) as rank from (
    select id, unnest(['x0', 'x1', 'x2']) as feature, unnest([0.1 * (x0 - 3), -0.05 * (x1 - 5), 0.2 * (x2 - 5.5)]) as value from survival) a) b where rank <= 2""", "survival"))
def m34(s, d):
    return rounded(survival.linear_contributions(FIXED, _survival(s, d), ["id"], 2), 8)


@query("m35_score_all")
def m35(s, d):
    rows = _survival_rows(s, d)
    cov = _covariates_of(rows)
    lab = labels.class_labels(rows, view(s, d, "flares"), keys=K, windows=[24, 48])
    both = durable(rows.join(lab, [*K, "timestamp"]))
    classifiers = {h: (classify.fit_logistic(both, f"label_{h}h", cov), both) for h in (24, 48)}
    broken = survival.CoxModel(["not_there"], [0.0], [1.0], FIXED.baseline)
    models = {"cox": (survival.fit_cox(rows, cov), rows), "gb": (survival.fit_boosted(rows, cov), rows), "broken": (broken, rows)}
    return scoring.score_all(rows, classifiers, models, keys=K)


@query("m37_backtest_run")
def m37(s, d):
    rows = _survival_rows(s, d, hours=24)
    actuals = view(s, d, "flares").where("class_category = 'M'").withColumn("series_id", F.col("series_id").cast("int"))
    return scoring.split_backtest(lambda part: survival.fit_cox(part, _covariates_of(part)), rows, actuals, since="2024-01-20 00:00:00", keys=K)[1]


@query("m39_guarded_run")
def m39(s, d):
    rows = _survival_rows(s, d)
    cov = _covariates_of(rows)
    early = F.col("timestamp") < F.expr("timestamp_ntz'2024-01-15'")
    model = survival.fit_cox(rows.where(early), cov)
    reference = monitor.drift_reference(rows.where(early), cov, ["timestamp", "series_id"])
    score = lambda f: survival.as_log_rows(survival.score_survival(model, f, [*K, "timestamp"]), "survival")
    tests, _ = scoring.score_run(
        rows.where(~early), cov, reference, score, log_path=staging_path(s, "log"), logged_at=F.col("observation_timestamp"), order=["timestamp", "series_id"]
    )
    return tests


# --- streams ------------------------------------------------------------------------------


def _land(s, df, label):
    """The table as a folder of landed files."""
    path = staging_path(s, label)
    df.write.parquet(path)
    return path, s.read.parquet(path).schema


END = dt.datetime(2100, 1, 1)  # later than any row by more than every lateness


def _land_in_order(s, df, order, label, ends: bool = False, after=END):
    """The same, each file later than the one before; with ``ends`` a last file that closes what is open."""
    path = staging_path(s, label)
    df.repartitionByRange(4, order).sortWithinPartitions(order).write.parquet(path)
    schema = s.read.parquet(path).schema
    # a stream takes files by their time, and these are written side by side
    place = s._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(s._jsc.hadoopConfiguration())
    for i, name in enumerate(sorted(f.getPath().getName() for f in files.listStatus(place))):
        files.setTimes(s._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), int(time.time() - 3600 + 2 * i) * 1000, -1)
    if ends:
        live.end_landing(s, path, schema, order, after)
    return path, schema


@query("t1_incremental_load", """select user_id, o as event_type, n from (select user_id, arg_max(event_type, ts) as o, count(*) as n from events group by 1) x""")
def t1(s, d):
    path, schema = _land(s, table(s, d, "events").select("user_id", "ts", "event_type", "event_id"), "landed")
    target = staging_path(s, "target")
    live.load_upserts(live.read_landed(s, path, schema), target, keys=["event_id"], order=["ts"], ts="ts", state=staging_path(s, "state"))
    loaded = s.read.parquet(target).join(table(s, d, "events").select("event_id", F.col("ts").alias("at")), "event_id")
    return loaded.groupBy("user_id").agg(F.max_by("event_type", "at").alias("event_type"), F.count("*").alias("n"))


@query("t2_drop_repeats", "select event_id, ts, event_type from events")
def t2(s, d):
    ev = table(s, d, "events").select("event_id", "ts", "event_type")
    path, schema = _land_in_order(s, ev.unionByName(ev), "ts", "twice")
    stream = live.read_landed(s, path, schema, files_per_batch=1).withColumn("ts", F.col("ts").cast("timestamp"))
    return live.collected(s, live.drop_repeats(stream, ["event_id"], "ts"), "once").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("t3_sliding_stats", oracle("""select series_id, w as window_start, w + interval 6 hour as window_end, count(flux_long) as n, q_14(avg(flux_long)) as mean, q_14(stddev_samp(flux_long)) as std,
      q_14(min(flux_long)) as min, q_14(max(flux_long)) as max
    from (select series_id, flux_long, unnest(generate_series(date_trunc('hour', timestamp) - interval 5 hour, date_trunc('hour', timestamp), interval 1 hour)) as w from flux) x group by 1, 2""", "flux"))
def t3(s, d):
    path, schema = _land_in_order(s, flux(s, d), "timestamp", "flux", ends=True)
    stream = live.read_landed(s, path, schema, files_per_batch=1).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    out = live.collected(s, live.sliding_stats(stream, "flux_long", keys=K, ts="timestamp"), "sliding")
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return rounded(out.withColumns(ntz), 14)


# Recursive oracle of the open event: one step per sample; what a step closes is in its e_ columns.
_LIVE = """with recursive nums as (select series_id, epoch_us(timestamp) as us, flux_long as v, row_number() over (partition by series_id order by timestamp, flux_long) as rn from flux where flux_long is not null),
    walk as (select series_id, rn, v >= 1e-6 as opened, us as start_us, us as peak_us, v as peak, us as last_us, cast(null as bigint) as e_start, cast(null as bigint) as e_peak_us, cast(null as double) as e_peak, cast(null as bigint) as e_end
        from nums where rn = 1
      union all select n.series_id, n.rn,
        case when w.opened and n.us - w.last_us <= 21600000000 then n.v >= 0.1 * w.peak else n.v >= 1e-6 end,
        case when w.opened and n.us - w.last_us <= 21600000000 then w.start_us else n.us end,
        case when w.opened and n.us - w.last_us <= 21600000000 and n.v <= w.peak then w.peak_us else n.us end,
        case when w.opened and n.us - w.last_us <= 21600000000 and n.v <= w.peak then w.peak else n.v end, n.us,
        case when w.opened and (n.us - w.last_us > 21600000000 or n.v < 0.1 * w.peak) then w.start_us end, case when w.opened then w.peak_us end, case when w.opened then w.peak end,
        case when n.us - w.last_us > 21600000000 then w.last_us else n.us end
      from walk w join nums n on n.series_id = w.series_id and n.rn = w.rn + 1),
    done as (select series_id, e_start as a, e_peak_us as b, e_end as c, e_peak as peak from walk where e_start is not null
      union all select series_id, start_us, peak_us, last_us, peak from walk where opened and (series_id, rn) in (select (series_id, max(rn)) from nums group by series_id))
    select series_id, make_timestamp(a) as start_time, make_timestamp(b) as peak_time, make_timestamp(c) as end_time, peak from done"""


@query("t4_live_events", oracle(_LIVE, "flux"))
def t4(s, d):
    rows = flux(s, d).select("series_id", micros("timestamp").alias("us"), F.col("flux_long").alias("v"))
    path, schema = _land_in_order(s, rows, "us", "samples", ends=True, after=int(END.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000)
    stream = live.read_landed(s, path, schema, files_per_batch=1)
    with live.state_store(s):
        return live.collected(s, live.live_events(stream, key="series_id"), "live")


@query("t5_grouped_events", oracle("""with b as (select *, case when peak_time - lag(peak_time) over (partition by active_region order by peak_time) < interval 1 hour then 0 else 1 end as o from flares),
      g as (select *, sum(o) over (partition by active_region order by peak_time) as k from b)
    select active_region, min(peak_time) as first_peak, count(*) as events, max(class_magnitude) as class_magnitude, arg_max(event_id, (class_magnitude, event_id)) as event_id from g group by active_region, k""", "flares"))
def t5(s, d):
    path, schema = _land_in_order(s, view(s, d, "flares"), "peak_time", "flares", ends=True)
    stream = live.read_landed(s, path, schema, files_per_batch=1).withColumn("peak_time", F.col("peak_time").cast("timestamp"))
    out = live.collected(s, live.grouped_events(stream, keys=["active_region"], ts="peak_time"), "sessions")
    return out.withColumn("first_peak", F.col("first_peak").cast("timestamp_ntz"))


@query("t6_matched_outcomes", oracle("""select p.event_id as id, e.event_id, e.peak_time from (select event_id, user_id % 4 as series_id, ts as timestamp from events where event_type = 'view') p
    join flares e on e.series_id = p.series_id and e.peak_time between p.timestamp and p.timestamp + interval 2 hour""", "flares"))
def t6(s, d):
    preds = table(s, d, "events").where("event_type = 'view'").select(F.col("event_id").alias("id"), F.expr("cast(user_id % 4 as int) as series_id"), F.col("ts").alias("timestamp"))
    pp, ps = _land_in_order(s, preds, "timestamp", "preds")
    ep, es = _land_in_order(s, view(s, d, "flares").select("event_id", "series_id", "peak_time"), "peak_time", "events")
    as_time = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp"))
    p, e = as_time(live.read_landed(s, pp, ps, files_per_batch=1), "timestamp"), as_time(live.read_landed(s, ep, es, files_per_batch=1), "peak_time")
    # pairs grow with the square of the density: runs are stored, and written out when read
    out = live.pairs(live.collected(s, live.matched_outcomes(p, e, hours=2, runs=True), "matched"))
    return out.withColumn("peak_time", F.col("peak_time").cast("timestamp_ntz"))


@query("t7_live_drift")
def t7(s, d):
    ev = table(s, d, "events").select("ts", "event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    path, schema = _land_in_order(s, ev, "ts", "rows")
    out = staging_path(s, "drift")
    live.live_drift(live.read_landed(s, path, schema, files_per_batch=1), ["value", "user_id"], ["ts", "event_id"], path=out, state=staging_path(s, "state"))
    return s.read.parquet(f"{out}/tests").drop("batch_no")


_SOURCES = {"view": "xray_flux", "click": "solar_regions", "purchase": "magnetogram", "signup": "flare_events", "error": "donki_flares"}


@query("t8_live_status", """select event_type, latest, n as rows, q_8(age) as age_hours, case when age < 24 then 'fresh' when age < 48 then 'stale' else 'outdated' end as status, failed,
      case when ok = required then 'success' when ok > 0 or optional > 0 then 'partial' else 'failed' end as overall_status
    from (select *, (epoch_us(timestamp '2024-02-01 00:00:00') - epoch_us(latest)) / 3.6e9 as age, count(*) filter (event_type <> 'error') over () as required,
        count(*) filter (event_type <> 'error' and not failed) over () as ok, count(*) filter (event_type = 'error' and not failed) over () as optional
      from (select event_type, max(ts) as latest, count(*) as n, arg_max(value > 60, ts) as failed from events group by 1) x) y""")
def t8(s, d):
    path, schema = _land_in_order(s, table(s, d, "events"), "ts", "status")
    out = staging_path(s, "statuses")
    live.live_status(live.read_landed(s, path, schema, files_per_batch=1), ts="ts", path=out, state=staging_path(s, "state"), by="event_type", failed=F.col("value") > 60)
    names = F.create_map(*[F.lit(v) for pair in _SOURCES.items() for v in pair])[F.col("event_type")]
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    return live.current_status(s, out, by="event_type", now=now, source_names=names).withColumn("age_hours", q(F.col("age_hours"), 8))
