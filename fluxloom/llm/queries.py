"""Registered queries of the corpus operators, under their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxloom.llm import alignment, ann, attention_lm, hnsw, html_text, licenses, line_runs, minhash, packing, pieces, rlz, runs, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op8_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4)


ORACLES["op8_minhash"] = r"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
t as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from w),
k as (select doc_id, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o as s from t window o as (partition by doc_id order by i)),
e as (select distinct doc_id, s from k where s is not null union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 3),
g as (select w.doc_id, count(e.s) as n from w left join e using (doc_id) group by 1),
f as (select s from e group by s having count(*) > 1),
c as (select x.doc_id as a, y.doc_id as b, count(*) as n from e x join f using (s) join e y on x.s = y.s and x.doc_id < y.doc_id group by 1, 2),
l as (select a, b from c join g x on x.doc_id = a join g y on y.doc_id = b where 100 * c.n >= 80 * (x.n + y.n - c.n)),
r as (with recursive r(v, m) as (select doc_id, doc_id from documents union select case when r.v = l.a then l.b else l.a end, r.m from r join l on r.v = l.a or r.v = l.b) select v, min(m) as m from r group by v)
select doc_id, n as n_shingles, m as component_id, doc_id = m as kept from g join r on r.v = doc_id
"""


@_query
def op2_rlz(spark, sf_dir):
    return rlz.substring_dedup(_table(spark, sf_dir, "documents"))


ORACLES["op2_rlz"] = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
t as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from w),
s as (select t.doc_id, t.i, md5(array_to_string(w.w[t.i : t.i + 49], ' ')) as h from t join w using (doc_id) where t.i + 49 <= len(w.w)),
f as (select h, min(doc_id) as d from s group by h),
b as (select s.doc_id, s.i from s join f using (h) where f.d < s.doc_id),
c as (select doc_id, i, max(p) over (partition by doc_id order by i rows between unbounded preceding and current row) as p from (select t.doc_id, t.i, b.i as p from t left join b on t.doc_id = b.doc_id and t.i = b.i)),
r as (select t.doc_id, t.i, t.w, coalesce(c.p, -99) + 49 >= t.i as gone from t join c on t.doc_id = c.doc_id and t.i = c.i)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(sum(gone::int), 0) as bigint) as n_removed,
sha256(coalesce(string_agg(r.w, ' ' order by r.i) filter (where not gone), '')) as kept_sha256
from w left join r using (doc_id) group by w.doc_id, w.w
"""


@_query
def op4_packing(spark, sf_dir):
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


@_query
def op7_toxicity(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity.held_out()
    model = toxicity.fit(docs, labels.where(~out))
    scored = toxicity.score(docs.select("doc_id", "text", out.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op1_ads(spark, sf_dir):
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query
def op6_html(spark, sf_dir):
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_query
def op10_licenses(spark, sf_dir):
    return licenses.license_spans(_table(spark, sf_dir, "documents"))


@_query
def op3_hnsw(spark, sf_dir):
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings"))


ORACLES["op3_hnsw"] = """
with v as (select vec_id, label, embedding::double[] as e from embeddings),
l as (select x.vec_id as a, y.vec_id as b from v x join v y on x.label = y.label and x.vec_id < y.vec_id
  where list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.93),
b as (select a, b from l union all select b, a from l),
r as (with recursive r(v, m) as (select vec_id, vec_id from v union select b.b, r.m from r join b on r.v = b.a) select v, min(m) as m from r group by v)
select vec_id, (select count(*) from b where b.a = v.vec_id) as n_links, m as component_id, vec_id = m as kept from v join r on r.v = vec_id
"""

ORACLES["op1_ads"] = """
with v as (select vec_id, embedding::double[] as e from embeddings),
d as (select q.vec_id as query_id, v.vec_id, list_distance(q.e, v.e) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as integer) as rank, vec_id, score from d)
select * from r where rank <= 10
"""


@_query
def op5_attention(spark, sf_dir):
    return attention_lm.score(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 != 1, vocabulary("word_bpe_49k.json"))


@_query
def op9_pieces(spark, sf_dir):
    path = vocabulary("piece_bpe_32k.model")
    digest = lambda c: F.sha2(F.coalesce(c, F.lit("")), 256)
    # texts are not carried through the decoder: their digests tell
    coded = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"), path).select("doc_id", digest("text").alias("digest"), "ids"), path)
    same = digest("decoded") == F.col("digest")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


@_query
def op13_line_runs(spark, sf_dir):
    kept = line_runs.without_common_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op13_line_runs"] = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as w from documents),
l as (select doc_id, unnest(w) as line, generate_subscripts(w, 1) as i from d),
k as (select doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
c as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
select k.doc_id, count(*) as n_lines, count(c.key) as n_dropped,
sha256(coalesce(string_agg(k.line, chr(10) order by k.i) filter (where c.key is null), '')) as kept_sha256
from k left join c on k.key = c.key group by k.doc_id
"""


def _made_periodic(doc_id, text):
    """The input of ``op12_runs``: by its contract, some documents go on as copies of their own words from one place on."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def tail(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " "))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, F.transform(F.array(words), tail)[0]).otherwise(text)


@_query
def op12_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", _made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = runs.with_runs(docs).withColumn("best", runs.strongest())
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _tokenizers():
    import public_tokenizers

    return alignment.rank_side(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN), alignment.piece_side(public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op11_alignment(spark, sf_dir):
    return alignment.aligned(_table(spark, sf_dir, "documents"), _tokenizers)[0]
