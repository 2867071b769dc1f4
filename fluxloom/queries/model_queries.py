"""Queries of preparation, evaluation and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import metrics, monitor, prep
from fluxloom.queries.registry import query, rounded
from fluxloom.queries.scalar_queries import _PRED_CASE, predicted, prob_map
from fluxloom.queries.views import oracle, table, view

DIMENSIONS = 64  # of the embedding vectors
FLUX_COLS = ["flux_short", "flux_long"]


# --- preparation --------------------------------------------------------------------------

_LINE = """select l_orderkey as region_number, cast(l_quantity as double) as quantity, cast(l_discount as double) as discount, 1e0 as constant,
    cast(l_tax as double) as label_24h, cast(l_extendedprice as double) as max_magnitude_24h, l_returnflag as mode from {lineitem}"""


def _lines(s, d):
    return s.sql(_LINE, lineitem=table(s, d, "lineitem"))


@query("p5_feature_columns", "select cast(l_quantity as double) as quantity, cast(l_discount as double) as discount, 1e0 as constant from lineitem")
def p5(s, d):
    df = _lines(s, d)
    return df.select(*prep.feature_columns(df))


@query("p6_clean_matrix", "select event_id, case when event_type in ('error', 'view', 'click') then 0 else value end as a, case when event_type = 'view' then 0 else value * 2 end as b from events")
def p6(s, d):
    kind, v = F.col("event_type"), F.col("value")
    a = F.when(kind == "error", None).when(kind == "view", F.lit(float("nan"))).when(kind == "click", F.lit(float("inf"))).otherwise(v)
    b = F.when(kind == "view", F.lit(float("-inf"))).otherwise(v * 2)
    return prep.clean_matrix(table(s, d, "events").select("event_id", a.alias("a"), b.alias("b")), ["a", "b"])


@query("p7_drop_constant", "select cast(l_quantity as double) as quantity, cast(l_discount as double) as discount from lineitem")
def p7(s, d):
    return prep.drop_constant(_lines(s, d).select("quantity", "discount", "constant"), ["quantity", "discount", "constant"])


@query("p8_align_features", "select event_id, 0e0 as b_missing, value as value, cast(user_id as double) as user_id from events")
def p8(s, d):
    return prep.align_features(table(s, d, "events"), ["b_missing", "value", "user_id"], keep=["event_id"])


def _impute_sql(kind):
    fill = {
        "mean": "(select avg({c}) from flux)",
        "median": "(select median({c}) from flux)",
        "zero": "0",
        "constant": "-1",
    }
    if kind in fill:
        return ", ".join(f"q_14(coalesce({c}, {fill[kind].format(c=c)})) as {c}" for c in FLUX_COLS)
    a, b = "last_value({c} ignore nulls) over (partition by series_id order by timestamp)", "first_value({c} ignore nulls) over (partition by series_id order by timestamp rows between current row and unbounded following)"
    first, second = (a, b) if kind == "forward_fill" else (b, a)
    return ", ".join(f"q_14(coalesce({first.format(c=c)}, {second.format(c=c)})) as {c}" for c in FLUX_COLS)


def _imputer(kind):
    def run(s, d):
        df = view(s, d, "flux").withColumn("series_id", F.col("series_id").cast("int"))
        return rounded(prep.impute(df, kind, FLUX_COLS, order_by=["timestamp"], keys=["series_id"], fill_value=-1), 14)

    return run


for _kind in ("mean", "median", "zero", "constant", "forward_fill", "backward_fill"):
    query(f"m5_impute_{_kind}", oracle(f"select cast(series_id as int) as series_id, timestamp, {_impute_sql(_kind)} from flux", "flux"))(_imputer(_kind))


@query("m5_impute_drop", oracle("select timestamp, flux_short, flux_long from flux where flux_short is not null and flux_long is not null", "flux"))
def m5_drop(s, d):
    return prep.impute(view(s, d, "flux").select("timestamp", *FLUX_COLS), "drop", FLUX_COLS)


_ZERO = "(select timestamp, coalesce(flux_short, 0) as flux_short, coalesce(flux_long, 0) as flux_long from flux)"


def _scaler(method):
    return lambda s, d: rounded(prep.scale(view(s, d, "flux").select("timestamp", *FLUX_COLS), FLUX_COLS, method), 8)


def _scale_sql(centre, spread):
    cols = ", ".join(f"q_8(({c} - (select {centre.format(c=c)} from z)) / (select {spread.format(c=c)} from z)) as {c}" for c in FLUX_COLS)
    return oracle(f"with z as (select * from {_ZERO} y) select timestamp, {cols} from z", "flux")


query("m6_scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))(_scaler("minmax"))
query("m7_scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))(_scaler("standard"))
query("m8_scale_robust", _scale_sql("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))(_scaler("robust"))


@query("m9_index_labels", "select event_id, event_type, cast(dense_rank() over (order by event_type) - 1 as double) as label_index from events")
def m9(s, d):
    return prep.index_labels(table(s, d, "events").select("event_id", "event_type"), "event_type")


@query("m10_class_weights", """select event_id, event_type, q_8(cast((select count(*) from events) as double) / ((select count(distinct event_type) from events) * count(*) over (partition by event_type))) as weight from events""")
def m10(s, d):
    return rounded(prep.class_weights(table(s, d, "events").select("event_id", "event_type"), "event_type"), 8)


_DRAWN = """(select event_id, event_type, row_number() over (partition by event_type order by md5(concat(event_id, '-', 42)), event_id) - 1 as i, count(*) over (partition by event_type) as n from events)"""


@query("m11_stratified_split", f"select event_id, event_type, i < floor(n * 0.2 + 0.5) as is_test from {_DRAWN} x")
def m11(s, d):
    return prep.stratified_split(table(s, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("m12_tail_split", "select o_orderkey, o_orderdate, row_number() over (order by o_orderdate, o_orderkey) - 1 >= floor(count(*) over () * (1 - 0.2e0) + 1e-9) as is_test from orders")
def m12(s, d):
    return prep.tail_split(table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query("m13_fold_column", f"select event_id, event_type, cast(i % 5 as int) as fold from {_DRAWN} x")
def m13(s, d):
    return prep.fold_column(table(s, d, "events").select("event_id", "event_type"), "event_type", "event_id")


def vectors(s, d, label="label"):
    """Embedding rows as numeric columns with an uneven four-way class."""
    e = table(s, d, "embeddings")
    key = e.columns[0]
    cls = F.when(F.pmod("label", F.lit(10)) < 5, 0).when(F.pmod("label", F.lit(10)) < 7, 1).when(F.pmod("label", F.lit(10)) < 9, 2).otherwise(3)
    return e.select(F.col(key).cast("bigint").alias("id"), cls.alias(label), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(DIMENSIONS)])


@query("m14_smote")
def m14(s, d):
    df = vectors(s, d)
    return prep.smote(df, "label", "id", [f"x{i}" for i in range(DIMENSIONS)])


@query("m14_smote_balance", """with v as (select cast(case when label % 10 < 5 then 0 when label % 10 < 7 then 1 when label % 10 < 9 then 2 else 3 end as int) as label from embeddings),
    n as (select label, count(*) as n from v group by 1) select label, (select max(n) from n) - n as made, true as inside from n where n < (select max(n) from n)""")
def m14_balance(s, d):
    """How many rows SMOTE makes of each class, and whether each lies in its class's box."""
    df, names = vectors(s, d), [f"x{i}" for i in range(DIMENSIONS)]
    made = prep.smote(df, "label", "id", names)
    box = df.groupBy("label").agg(F.array(*[F.min(c) for c in names]).alias("least"), F.array(*[F.max(c) for c in names]).alias("most"))
    values = F.array(*[F.col(c) for c in names])
    inside = F.forall(F.arrays_zip("least", "most", values.alias("v")), lambda x: (x["v"] >= x["least"] - 1e-9) & (x["v"] <= x["most"] + 1e-9))
    return made.join(box, "label").groupBy("label").agg(F.count("*").alias("made"), F.bool_and(inside).alias("inside"))


# --- evaluation ---------------------------------------------------------------------------

PROBS = {"None": "p_none", "C": "p_c", "M": "p_m", "X": "p_x"}


@query("m19_brier", oracle("with b as (" + " union all ".join(f"select '{n}' as class_name, avg(pow({c} - case when actual = '{n}' then 1 else 0 end, 2)) as b from class_probs" for n, c in PROBS.items())
    + ") select class_name, q_8(b) as brier from b union all select 'macro_avg', q_8(avg(b)) from b", "class_probs"))
def m19(s, d):
    return rounded(metrics.brier(view(s, d, "class_probs"), "actual", PROBS), 8)


def _auc_sql():
    one = lambda n, c: f"""select '{n}' as class_name, sum(pos * (neg_upto - neg / 2e0)) / (sum(pos) * sum(neg)) as a from (
        select p, pos, neg, sum(neg) over (order by p) as neg_upto from (select {c} as p, cast(count(*) filter (actual = '{n}') as double) as pos, cast(count(*) filter (actual <> '{n}') as double) as neg from class_probs group by 1) x) y"""
    parts = " union all ".join(one(n, c) for n, c in PROBS.items())
    return f"with b as ({parts}) select class_name, q_8(a) as auc from b union all select 'macro_avg', q_8(avg(a)) from b"


@query("m20_roc_auc", oracle(_auc_sql(), "class_probs"))
def m20(s, d):
    return rounded(metrics.roc_auc(view(s, d, "class_probs"), "actual", PROBS), 8)


@query("m20_roc_auc_binary", oracle("""with c as (select p, cast(sum(y) as double) as pos, cast(sum(1 - y) as double) as neg from preds group by 1),
      b as (select sum(pos * (u - neg / 2)) / (sum(pos) * sum(neg)) as a from (select *, sum(neg) over (order by p) as u from c) x)
    select '1' as class_name, q_8(a) as auc from b union all select 'macro_avg', q_8(a) from b""", "preds"))
def m20b(s, d):
    return rounded(metrics.roc_auc(view(s, d, "preds"), "y", {"1": "p"}), 8)


_REPORT = f"""with t as (select actual as y, {_PRED_CASE} as z from class_probs), k as (select distinct y as c from t union select distinct z from t),
    r as (select c, count(*) filter (y = c) as support, count(*) filter (y = c and z = c) as hits, count(*) filter (z = c) as called from k, t group by 1),
    m as (select c as class_name, coalesce(hits / nullif(cast(called as double), 0), 0) as p, coalesce(hits / nullif(cast(support as double), 0), 0) as r, support, hits from r),
    f as (select class_name, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0) as f, support, hits from m)
    select class_name, q_8(p) as precision, q_8(r) as recall, q_8(f) as f1, support from f
    union all select 'macro avg', q_8(avg(p)), q_8(avg(r)), q_8(avg(f)), cast(sum(support) as bigint) from f
    union all select 'weighted avg', q_8(sum(p * support) / sum(support)), q_8(sum(r * support) / sum(support)), q_8(sum(f * support) / sum(support)), cast(sum(support) as bigint) from f
    union all select 'accuracy', null, null, q_8(sum(hits) / cast(sum(support) as double)), cast(sum(support) as bigint) from f"""


@query("m21_confusion", oracle(f"select actual as truth, {_PRED_CASE} as predicted, count(*) as n from class_probs group by 1, 2", "class_probs"))
def m21a(s, d):
    return metrics.confusion(view(s, d, "class_probs").withColumn("predicted", predicted()), "actual", "predicted")


@query("m21_classification_report", oracle(_REPORT, "class_probs"))
def m21(s, d):
    return rounded(metrics.classification_report(view(s, d, "class_probs").withColumn("predicted", predicted()), "actual", "predicted"), 8)


@query("m22_reliability", oracle(" union all ".join(f"""select '{n}' as class_name, cast(least(floor({c} * 10), 9) as int) as bin, q_8(avg({c})) as mean_predicted,
    q_8(avg(case when actual = '{n}' then 1 else 0 end)) as positive_rate, count(*) as n from class_probs group by 2""" for n, c in PROBS.items()), "class_probs"))
def m22(s, d):
    return rounded(metrics.reliability(view(s, d, "class_probs"), "actual", PROBS), 8)


@query("m30_concordance", oracle("""with g as (select duration as d, event as e, score as s, count(*) as n from survival group by 1, 2, 3),
    x as (select a.n * b.n as w, a.s as sa, b.s as sb from g a join g b on a.e = 1 and (b.d > a.d or (b.d = a.d and b.e = 0)))
    select cast(sum(w) as bigint) as pairs, cast(coalesce(sum(w) filter (sa > sb), 0) as bigint) as concordant, cast(coalesce(sum(w) filter (sa = sb), 0) as bigint) as ties,
      q_8((coalesce(sum(w) filter (sa > sb), 0) + coalesce(sum(w) filter (sa = sb), 0) / 2e0) / sum(w)) as c_index from x""", "survival"))
def m30(s, d):
    return rounded(metrics.concordance(view(s, d, "survival")), 8)


# --- monitoring ---------------------------------------------------------------------------

_HALF = "timestamp '2024-01-15'"
_DRIFT = ["value", "user_id"]


def _halves(s, d):
    ev = table(s, d, "events").select("ts", "event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    early = F.col("ts") < F.expr("timestamp_ntz'2024-01-15'")
    return ev.where(early), ev.where(~early)


_REF = f"""(select 'value' as feature, ts, event_id, value from events where ts < {_HALF} qualify row_number() over (order by ts desc, event_id desc) <= 1000
    union all select 'user_id', ts, event_id, cast(user_id as double) from events where ts < {_HALF} qualify row_number() over (order by ts desc, event_id desc) <= 1000)"""
_CUR = f"(select 'value' as feature, value from events where ts >= {_HALF} union all select 'user_id', cast(user_id as double) from events where ts >= {_HALF})"


@query("q1_drift_reference", f"select feature, ts, event_id, value from {_REF} r")
def q1(s, d):
    return monitor.drift_reference(_halves(s, d)[0], _DRIFT, ["ts", "event_id"])


_COUNTED = f"""v as (select feature, value, cast(sum(r) as double) as r, cast(sum(c) as double) as c from (select feature, value, 1 as r, 0 as c from {_REF} a union all select feature, value, 0, 1 from {_CUR} b) x group by 1, 2)"""


@query("q2_ks_drift", f"""with {_COUNTED} select feature, cast(nr as bigint) as ref_rows, cast(nc as bigint) as cur_rows, q_8(max(abs(ur / nr - uc / nc))) as statistic from (
      select feature, sum(r) over w as ur, sum(c) over w as uc, sum(r) over (partition by feature) as nr, sum(c) over (partition by feature) as nc from v window w as (partition by feature order by value)) y group by 1, 2, 3""")
def q2(s, d):
    early, late = _halves(s, d)
    ref = monitor.drift_reference(early, _DRIFT, ["ts", "event_id"])
    return rounded(monitor.ks_drift(ref, monitor.long_form(late, _DRIFT)), 8).select("feature", "ref_rows", "cur_rows", "statistic")


@query("q3_rank_drift", f"""with {_COUNTED} select feature, cast(sum(r) as bigint) as ref_rows, cast(sum(c) as bigint) as cur_rows,
      q_4(sum(r * (u - n + (n + 1) / 2)) - sum(r) * (sum(r) + 1) / 2) as statistic from (select *, r + c as n, sum(r + c) over (partition by feature order by value) as u from v) y group by 1""")
def q3(s, d):
    early, late = _halves(s, d)
    ref = monitor.drift_reference(early, _DRIFT, ["ts", "event_id"])
    return rounded(monitor.rank_drift(ref, monitor.long_form(late, _DRIFT)), 4).select("feature", "ref_rows", "cur_rows", "statistic")


@query("q4_drift_summary", f"""with {_COUNTED}, ks as (select feature, nr, nc, max(abs(ur / nr - uc / nc)) as d from (
      select feature, sum(r) over w as ur, sum(c) over w as uc, sum(r) over (partition by feature) as nr, sum(c) over (partition by feature) as nc from v window w as (partition by feature order by value)) y group by 1, 2, 3),
    tail as (select feature, 2 * (exp(-2 * l) - exp(-8 * l) + exp(-18 * l) - exp(-32 * l) + exp(-50 * l)) as p from (select feature, d * d * nr * nc / (nr + nc) as l from ks) x)
    select coalesce(list_sort(list(feature) filter (p < 0.05)), []) as drifted_features, count(*) as tested, coalesce(bool_or(p < 0.05), false) as overall_drift from tail""")
def q4(s, d):
    early, late = _halves(s, d)
    ref = monitor.drift_reference(early, _DRIFT, ["ts", "event_id"])
    return monitor.drift_summary(monitor.ks_drift(ref, monitor.long_form(late, _DRIFT)))


@query("q5_drop_sparse", "select event_id, case when event_type = 'view' then null else value end as kept from events")
def q5(s, d):
    ev = table(s, d, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("kept"), F.when(F.col("event_type") == "view", F.col("value")).alias("sparse"))
    return prep.drop_sparse(ev, ["kept", "sparse"])


_VALID = """(select event_id, value, event_id // 4 as run_id, event_type,
      case when event_type = 'error' then 0e0 when event_type = 'signup' then 1e-6 else 1 - exp(-168 / l) end as total,
      case when event_type = 'error' then null else value / 100 end as hazard, l from (select *, case when value > 100 then 1e7 when value < 2 then 0.5e0 else 10 + value end as l from events) e)"""
_REASON = """case when total = 0 and coalesce(hazard, 0) = 0 then 'survival prediction total probability is zero' else '' end as r1,
    case when not (total = 0 and coalesce(hazard, 0) = 0) and total < 0.0001 and not coalesce(hazard > 0, false) then 'survival prediction total probability too low' else '' end as r2,
    case when not (total >= 0.0001 or coalesce(hazard > 0, false)) then '' when 1 - exp(-168 / l) < 0.001 then 'survival function nearly flat'
      when exp(-48 / l) <= 0.01 then 'survival function collapses to zero inside prediction horizon'
      when greatest(1 - exp(-6 / l), exp(-6 / l) - exp(-48 / l), exp(-48 / l) - exp(-168 / l)) > 0.9 then 'survival function has abrupt drop' else '' end as r3"""
_CHECKED = f"(select event_id, run_id, list_filter([r1, r2, r3], lambda x: x <> '') as reasons from (select event_id, run_id, {_REASON} from {_VALID} v) w)"


def _checked(s, d):
    life = F.when(F.col("value") > 100, 1e7).when(F.col("value") < 2, 0.5).otherwise(10 + F.col("value"))
    kind = F.col("event_type")
    total = F.when(kind == "error", 0.0).when(kind == "signup", 1e-6).otherwise(1 - F.exp(-168 / F.col("l")))
    hazard = F.when(kind != "error", F.col("value") / 100)
    curve = F.array(*[F.exp(-F.lit(float(h)) / F.col("l")) for h in (0, 6, 48, 168)])
    ev = table(s, d, "events").withColumn("l", life)
    reasons = monitor.survival_reasons(F.create_map(F.lit("0h-168h"), total), hazard, curve)
    return ev.select("event_id", F.expr("event_id div 4").alias("run_id"), reasons.alias("reasons"))


@query("q6_prediction_validity", f"select event_id, array_to_string(reasons, '|') as reasons from {_CHECKED} c")
def q6(s, d):
    return _checked(s, d).select("event_id", F.array_join("reasons", "|").alias("reasons"))


@query("q6_class_validity", oracle("select id, case when abs(p_none + p_c + p_m + p_x * 3 - 1) > 0.1 then 'classification probabilities don''t sum to 1' else '' end as reasons from class_probs", "class_probs"))
def q6b(s, d):
    off = view(s, d, "class_probs").withColumn("p_x", F.col("p_x") * 3)
    return off.select("id", F.array_join(monitor.class_reasons(prob_map()), "|").alias("reasons"))


@query("q7_guardrail_rollup", f"""select run_id, case when count(r) = 0 then 'pass' else 'fail' end as status, count(r) as errors, count(r) > 0 as guardrail_triggered,
    substr(string_agg(distinct r, '; ' order by r), 1, 500) as guardrail_reason from (select run_id, event_id, unnest(case when len(reasons) = 0 then [null] else reasons end) as r from {_CHECKED} c) x group by 1""")
def q7(s, d):
    return monitor.guardrail_rollup(_checked(s, d), "run_id", "reasons")


def _validations(s, d):
    return table(s, d, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.struct("o_orderdate", "o_orderkey").alias("run_timestamp"),
        F.when(F.col("o_orderstatus") == "O", "pass").otherwise("fail").alias("status"),
        (F.col("o_orderstatus") == "F").alias("guardrail_triggered"),
        F.when(F.col("o_orderstatus") == "F", F.lit("survival function nearly flat")).alias("guardrail_reason"),
    )


@query("q8_validation_confidence", """select o_custkey, case when s = 'F' then 'low' when s = 'O' then 'normal' else 'low' end as confidence from
    (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s from orders group by 1) x""")
def q8(s, d):
    return monitor.validation_confidence(_validations(s, d), by=["o_custkey"]).select("o_custkey", "confidence")


@query("q8_clear_guardrail", """select o_orderkey, o_orderstatus = 'F' and not newest as guardrail_triggered, case when o_orderstatus = 'F' and not newest then 'survival function nearly flat' end as guardrail_reason
    from (select *, o_orderstatus = 'F' and (o_orderdate, o_orderkey) = max((o_orderdate, o_orderkey)) filter (o_orderstatus = 'F') over (partition by o_custkey) as newest from orders) x""")
def q8b(s, d):
    return monitor.clear_guardrail(_validations(s, d), by=["o_custkey"]).select("o_orderkey", "guardrail_triggered", "guardrail_reason")


@query("q9_version_comparison", """select model, version, q_8(c_index) as c_index, q_8(p) as previous, q_8(c_index - p) as change,
      case when p is null then null when c_index - p > 0 then 'improved' when c_index - p < -0.05 then 'worse' else 'similar' end as verdict
    from (select *, lag(c_index) over (partition by model order by version) as p from (select o_custkey as model, o_orderkey as version, cast(o_totalprice as double) / 500000 as c_index from orders) x) y""")
def q9(s, d):
    m = table(s, d, "orders").select(F.col("o_custkey").alias("model"), F.col("o_orderkey").alias("version"), (F.col("o_totalprice").cast("double") / 500000).alias("c_index"))
    return rounded(monitor.version_comparison(m), 8)


_HEALTH = """select {k} as model, avg(pow(p_m - case when actual = 'M' then 1 else 0 end, 2)) as brier, count(*) filter (actual = 'M' and p_m > 0.2) / cast(nullif(count(*) filter (p_m > 0.2), 0) as double) as precision,
    count(*) filter (actual = 'M' and p_m > 0.2) / cast(nullif(count(*) filter (actual = 'M'), 0) as double) as recall from class_probs where timestamp {w} timestamp '2024-01-15' group by 1"""


@query("q10_retrain_trigger", oracle(f"""with c as ({_HEALTH.format(k='kind', w='>=')}), b as ({_HEALTH.format(k='kind', w='<')}),
    j as (select c.*, b.brier as brier_base from c left join b using (model))
    select model, q_8(brier) as brier, q_8(precision) as precision, q_8(recall) as recall, q_8(brier_base) as brier_base,
      array_to_string(list_filter([case when brier > brier_base * 1.1 then 'brier' end, case when precision < 0.5 then 'precision' end, case when recall < 0.5 then 'recall' end], lambda x: x is not null), ',') as reasons,
      coalesce(brier > brier_base * 1.1, false) or coalesce(precision < 0.5, false) or coalesce(recall < 0.5, false) as retrain from j""", "class_probs"))
def q10(s, d):
    v = view(s, d, "class_probs")
    early = F.col("timestamp") < F.expr("timestamp_ntz'2024-01-15'")
    called, real = F.col("p_m") > 0.2, F.col("actual") == "M"

    def health(df):
        return df.groupBy(F.col("kind").alias("model")).agg(
            F.avg(F.pow(F.col("p_m") - real.cast("int"), 2)).alias("brier"),
            F.try_divide(F.count_if(called & real).cast("double"), F.count_if(called)).alias("precision"),
            F.try_divide(F.count_if(called & real).cast("double"), F.count_if(real)).alias("recall"),
        )

    return rounded(monitor.retrain_trigger(health(v.where(~early)), health(v.where(early)), ["model"]), 8)
