"""The driver tables seen as flux, events, regions and predictions.

Each view is one SQL text that Spark and the oracle engine run unchanged; table names are
placeholders in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "flux": """
        select user_id % 4 as series_id, ts as timestamp,
               case when event_type = 'error' then null else value * 3e-7 end as flux_long,
               case when event_type = 'signup' then null else value * 2e-8 end as flux_short
        from {events}""",
    "xray_raw": """
        select ts as time_tag, '0.05-0.4nm' as energy, cast(floor(value * 1e6 + 0.537) as double) / 2e14 as flux, 'G16' as satellite
        from {events} where event_type <> 'signup'
        union all
        select ts, '0.1-0.8nm', cast(floor(value * 1e6 + 0.537) as double) / 1e13, 'G16' from {events} where event_type <> 'error'""",
    "flares": """
        select event_id, ts as start_time, ts + interval 15 minutes as peak_time, ts + interval 40 minutes as end_time,
               case when f >= 1e-4 then 'X' when f >= 1e-5 then 'M' when f >= 1e-6 then 'C' else 'B' end as class_category,
               floor(10 * (case when f >= 1e-4 then f / 1e-4 when f >= 1e-5 then f / 1e-5
                                when f >= 1e-6 then f / 1e-6 else f / 1e-7 end) + 0.5) / 10e0 as class_magnitude,
               cast(user_id % 20 as int) as active_region, cast(user_id % 4 as int) as series_id,
               case when event_id % 3 = 0 then 'nasa_donki' else 'auto_detected' end as source
        from (select *, value * 3e-7 as f from {events} where event_type in ('purchase', 'signup')) e""",
    "regions": """
        select ts as timestamp, cast(user_id % 20 as int) as region_number, cast(user_id % 4 as int) as series_id,
               case event_id % 8 when 0 then 'Dkc' when 1 then 'Ekc' when 2 then 'Axx' when 3 then 'Cso'
                                 when 4 then 'hsx' when 5 then ' Fki ' when 6 then 'B' else null end as mcintosh_class,
               case event_id % 7 when 0 then 'alpha' when 1 then 'Beta' when 2 then 'beta-gamma'
                                 when 3 then 'Beta-Gamma-Delta' when 4 then '' when 5 then 'gamma' else null end as mount_wilson_class,
               cast(floor(value) as int) as area, cast(event_id % 30 as int) as num_sunspots
        from {events} where event_type = 'view'""",
    "preds": """
        select l.doc_id as id, cast(l.quality as int) as y, cast(d.n_chars % 1000 as double) / 1000 as p
        from {labels} l join {documents} d on l.doc_id = d.doc_id""",
    "class_probs": """
        select event_id as id, ts as timestamp, event_type as kind,
               cast(floor(b / s * 1e6 + 0.537) as double) / 1e6 as p_none,
               cast(floor(c / s * 1e6 + 0.537) as double) / 1e6 as p_c,
               cast(floor(m / s * 1e6 + 0.537) as double) / 1e6 as p_m,
               cast(floor(x / s * 1e6 + 0.537) as double) / 1e6 as p_x,
               case when value * 3e-7 >= 5e-5 then 'X' when value * 3e-7 >= 1e-5 then 'M'
                    when value * 3e-7 >= 2e-6 then 'C' else 'None' end as actual
        from (select *, 40e0 + event_id % 37 as b, value as c, value / 3 + event_id % 11 as m, value / 12 + event_id % 5 as x,
                     40e0 + event_id % 37 + value + value / 3 + event_id % 11 + value / 12 + event_id % 5 as s
              from {events}) e""",
    "survival": """
        select o_orderkey as id, cast(o_orderkey % 4 as int) as series_id,
               cast(floor(o_totalprice) as double) % 168 + 1 as duration,
               case when o_orderstatus = 'F' then 1 else 0 end as event,
               cast(o_custkey % 50 as double) / 10 as score,
               cast(o_orderkey % 7 as double) as x0, cast(o_custkey % 11 as double) as x1,
               cast(floor(o_totalprice) % 168 as double) / 24 + cast(o_orderkey % 5 as double) as x2, 1e0 as x3
        from {orders}""",
}

_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def oracle(body: str, *names: str) -> str:
    """``body`` with the named views (and what it reads in braces) in front as CTEs."""
    found = [n for n in names]
    ctes = ",\n".join(f"{n} as ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in found)
    stripped = body.strip()
    if not found:
        return stripped
    if stripped.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{stripped[len('with recursive '):]}"
    if stripped.lower().startswith("with "):
        return f"with {ctes},\n{stripped[5:]}"
    return f"with {ctes}\n{stripped}"

