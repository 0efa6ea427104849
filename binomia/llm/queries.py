"""Registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, license_scan, media, packing, pii, ppm, quality, secret_scan, suffix, warc, whitening
from .jaccard import jaccard_components


#: Setting that holds the secret key of surrogates; whoever knows the key can undo them.
KEY_SETTING = "spark.binomia.surrogateKey"
#: Serves where the setting is missing, for tests and public data only.
TEST_KEY = "surrogates of this corpus"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _count(column: str, field: str, value: object) -> Column:
    return F.size(F.filter(column, lambda x: x[field] == F.lit(value))).cast("long")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(_docs(spark, sf_dir), words=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.repeated_passages(_docs(spark, sf_dir), length=50)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return found.select("doc_id", "n_words", "n_repeated", spans.alias("spans"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)
    return warc.read_records(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    key = pii.distinct_key(docs, spark.conf.get(KEY_SETTING, None) or TEST_KEY)
    counts = {f"n_{k}": _count("entities", "kind", k) for k in pii.KINDS}
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["stop"])), ",")
    return pii.pseudonymised(docs, key).withColumns(counts).select("doc_id", "text", *counts, spans.alias("entities"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_matches(_docs(spark, sf_dir))
    listed = F.array_join(F.transform("licenses", lambda m: F.concat_ws(":", m["license"], m["start"], m["stop"])), ",")
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), F.size("licenses").alias("n_matches"), listed.alias("matches"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.benchmark_hits(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=13)
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), capacity=2048)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(_docs(spark, sf_dir))
    count = {k: _count("spans", "ord", k) for k in range(secret_scan.BASE)}
    base = F.filter("spans", lambda s: s["ord"] < secret_scan.BASE)
    return found.select(
        "doc_id",
        *[count[k].alias(f"n_{secret_scan.RULES[k].kind}") for k in count],
        F.sha2(secret_scan.rendered(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.rendered(F.col("spans")).alias("spans"),
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = media.media_features(media.media_column(_docs(spark, sf_dir)))
    feature = F.format_string("%dx%d:%s:%s", "width", "height", "thumbnail_hash", "thumbnail_sha256")
    kept = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return seen.select(*kept, feature.alias("feature"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whitened_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))  # null beyond 2^63


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_docs(spark, sf_dir))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ppm.lm_scores(_docs(spark, sf_dir), ~ppm.held_out())
    return scored.withColumn("held_out", ~F.col("learns")).drop("learns")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_suffix_array_dedup, op3_warc, op4_pii_surrogates, op5_license_scan,
        op6_quality_classifier, op7_decontamination, op8_best_fit_packing, op9_secret_scan, op10_media_columns,
        op11_embedding_whitening, op12_source_divergence, op13_lm_scoring,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ANY_CASE = {w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api", "key")}
_ASSIGN = rf"({_ANY_CASE['password']}|{_ANY_CASE['passwd']}|{_ANY_CASE['secret']}|{_ANY_CASE['token']}|{_ANY_CASE['api']}_?{_ANY_CASE['key']})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"


def _secret_sql() -> str:
    spans = []
    for k, (pattern, group, least) in enumerate(((_ASSIGN, 2, 6), ("AKIA[A-Z0-9]+", 0, 20), ("[0-9a-f]+", 0, 24))):
        spans.append(
            f"select doc_id, text, {k} ord, string_split_regex(t, '{pattern}') gaps, regexp_extract_all(t, '{pattern}', 0) found, regexp_extract_all(t, '{pattern}', {group}) tested, {least} least from d"
        )
    return f"""
with d as (select row_number() over () rid, doc_id, text, coalesce(text, '') t from documents),
m as ({' union all '.join(x.replace('select doc_id, text', 'select rid, doc_id') for x in spans)}),
e as (select rid, ord, least, gaps, found, tested, unnest(range(1, len(found) + 1)) i from m),
p as (select rid, ord, length(tested[i]) >= least ok, length(found[i]) size,
  list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) s from e),
q as (select rid, ord, cast(s as bigint) s, cast(s as bigint) + size t from p where ok),
g as (select rid, count(*) filter (ord = 0) a, count(*) filter (ord = 1) k, count(*) filter (ord = 2) h,
  string_agg((['assign', 'access', 'hex'])[ord + 1] || ':' || s || ':' || t, ',' order by s, ord) r from q group by rid)
select doc_id, coalesce(a, 0) n_assign, coalesce(k, 0) n_access, coalesce(h, 0) n_hex, sha256(coalesce(r, '')) base_sha256, coalesce(r, '') spans
from d left join g using (rid)"""


_BASE32 = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + "
    + " + ".join(f"{16 >> j} * cast(substr(bits, {5 * i + j + 1}, 1) as integer)" for j in range(5))
    + ", 1)"
    for i in range(32)
)

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": f"""
with recursive d as (select doc_id, {_SPACE_WORDS} w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end) g from d),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
r as (select doc_id, doc_id c from documents union select r.doc_id, l.y from r join l on l.x = r.c)
select r.doc_id, coalesce(any_value(n.n), 0) n_shingles, min(c) component_id from r left join n using (doc_id) group by r.doc_id""",
    "op2_suffix_array_dedup": f"""
with d as (select row_number() over () rid, doc_id, {_SPACE_WORDS} w from documents),
s as (select rid, unnest(range(0, greatest(len(w) - 49, 0))) i, w from d),
h as (select rid, i, array_to_string(w[i+1:i+50], ' ') g from s),
k as (select g from h group by g having count(*) > 1),
o as (select rid, i, case when i - lag(i) over (partition by rid order by i) <= 50 then 0 else 1 end fresh from h semi join k using (g)),
c as (select rid, i, sum(fresh) over (partition by rid order by i) run from o),
z as (select rid, run, min(i) a, max(i) + 50 b from c group by rid, run),
t as (select rid, sum(b - a) n, string_agg(a || ':' || b, ',' order by a) spans from z group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n, 0) as bigint) n_repeated, coalesce(spans, '') spans from d left join t using (rid)""",
    "op3_warc": f"""
with p as (select page_id, coalesce(html, '') h from pages),
r as (select h, min(page_id) f from p group by h),
b as (select page_id, h, f, cast(cast(unhex(sha1(h)) as bit) as varchar) bits from p join r using (h))
select page_id, cast(strlen(h) as bigint) payload_bytes, {_BASE32} payload_digest,
  case when page_id = f then 'response' else 'revisit' end record_type, case when page_id <> f then f end refers_to from b""",
    "op7_decontamination": f"""
with b as (select cast(item_id as varchar) item, {_ALNUM_WORDS} w from benchmark),
bg as (select distinct item, unnest(list_transform(range(1, greatest(len(w) - 11, 2)), lambda i: array_to_string(w[i:i+12], ' '))) g, least(len(w), 13) k from b where len(w) > 0),
ks as (select distinct k from bg),
d as (select row_number() over () rid, doc_id, {_ALNUM_WORDS} w from documents),
dw as (select rid, k, w, unnest(range(1, len(w) - k + 2)) i from d join ks on len(w) >= k),
dg as (select rid, k, i, array_to_string(w[i:i+k-1], ' ') g from dw),
o as (select rid, i, dg.k, item from dg join bg on dg.g = bg.g and dg.k = bg.k),
x as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + k)) p from o) group by rid),
y as (select rid, count(distinct item) n_items, string_agg(distinct item, ',' order by item) items from o group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join x using (rid) left join y using (rid)""",
    "op9_secret_scan": _secret_sql(),
    "op12_source_divergence": rf"""
with d as (select row_number() over () rid, coalesce(lang, '') lang, coalesce(source, '') source, {_LOWER} t from documents),
g as (select distinct lang, source from d),
o as (select rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
k as (select lang, term from o group by all having count(distinct rid) >= 3),
c as (select lang, source, term, count(*) n from o semi join k using (lang, term) group by all),
v as (select g.lang, coalesce(any_value(x.v), 0) v from (select distinct lang from g) g left join (select lang, count(*) v from k group by lang) x using (lang) group by g.lang),
t as (select lang, source, coalesce(any_value(x.n), 0) total, any_value(v) v from g join v using (lang) left join (select lang, source, sum(n) n from c group by all) x using (lang, source) group by all),
p as (select t.lang, t.source, k.term, coalesce(c.n, 0) n, cast(1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (total + v) as bigint) p
  from t join k using (lang) left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
l as (select lang, term, cast(1 + 1000000000::hugeint * (n + 1) // (sum(n) over (partition by lang) + v) as bigint) q from (select lang, term, sum(n) n from c group by all) join v using (lang)),
s as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' part, b.source item, cast(coalesce(f, 0) as bigint) "value" from g a join g b on a.lang = b.lang and a.source <> b.source
  left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // q from p join l using (lang, term) where n > 0 and p > q)
select lang, source, part, item, "value", cast(row_number() over (partition by lang, source, part order by "value" desc, item) as int) "rank" from r
qualify part = 'pair' or "rank" <= 200""",
}
