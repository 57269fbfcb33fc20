"""Recall: keyword and vector search, their fusion and the re-ranking stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.functions import text as T
from recallgrid.operators import rank as R
from recallgrid.registry import query
from recallgrid.sources import index

FLOOR, LIMIT = 0.1, 5
#: Steps that the checks share.
TERMS = f"terms AS (SELECT DISTINCT query_id, owner, unnest({T.tokens_sql('query')}) AS term FROM asked)"


def _postings_sql(rows: str, x: str = "") -> str:
    return f"""tok{x} AS (SELECT id, user_id AS owner, unnest({T.tokens_sql("content")}) AS term FROM mem WHERE dead = 0 AND {rows}),
postings{x} AS (SELECT owner, id, term, count(*) AS tf FROM tok{x} GROUP BY 1, 2, 3),
lengths{x} AS (SELECT m.user_id AS owner, m.id, coalesce(sum(p.tf), 0) AS dl FROM mem m LEFT JOIN postings{x} p ON p.id = m.id WHERE m.dead = 0 AND {rows} GROUP BY 1, 2)"""


def _bm25_sql(x: str = "") -> str:
    """Rows of nobody belong to every owner's scope."""
    return f"""scope{x} AS (SELECT query_id, count(*) AS N, avg(dl) AS avgdl FROM (SELECT DISTINCT query_id, owner FROM terms) t JOIN lengths{x} l ON l.owner IN (t.owner, '') GROUP BY 1),
need{x} AS (SELECT query_id, CASE WHEN count(*) <= 3 THEN count(*) ELSE ceil(count(*) * 0.75) END AS need FROM terms GROUP BY 1),
found{x} AS (SELECT t.query_id, t.term, p.id, p.tf, count(*) OVER (PARTITION BY t.query_id, t.term) AS df FROM terms t JOIN postings{x} p ON p.term = t.term AND p.owner IN (t.owner, '')),
part{x} AS (SELECT query_id, f.id, ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END)) AS s
  FROM found{x} f JOIN lengths{x} l ON l.id = f.id JOIN scope{x} USING (query_id)),
kw{x} AS (SELECT * FROM (SELECT query_id, id, round(sum(s), 9) AS kscore, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(s), 9) DESC, id) - 1 AS kpos
  FROM part{x} JOIN need{x} USING (query_id) GROUP BY query_id, id, need HAVING count(*) >= need) WHERE kpos < 50)"""


POSTINGS = _postings_sql("layer <> 'l2_raw'")
BM25 = f"{POSTINGS}, {TERMS}, {_bm25_sql()}"
VECTOR = """vec AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS pos FROM
  (SELECT query_id, id, round(list_cosine_similarity(q_embedding::DOUBLE[], embedding::DOUBLE[]), 9) AS score FROM asked JOIN mem ON user_id IN (owner, '') WHERE dead = 0)) WHERE pos < 15)"""
#: The intent of a query sets how much each ranking counts.
INTENT = """intent AS (SELECT query_id, query, kind, CASE kind WHEN 'navigational' THEN 0.6::DOUBLE WHEN 'conceptual' THEN 1.15::DOUBLE ELSE 1::DOUBLE END AS wv, CASE kind WHEN 'navigational' THEN 1.4::DOUBLE WHEN 'conceptual' THEN 0.85::DOUBLE ELSE 1::DOUBLE END AS wk
  FROM (SELECT query_id, query, CASE WHEN len(list_filter(string_split(query, ' '), lambda w: w <> '')) BETWEEN 1 AND 3 AND len(list_filter(string_split(query, ' '), lambda w: regexp_matches(regexp_replace(w, '^[.,;:!?"''()\\[\\]{}]+|[.,;:!?"''()\\[\\]{}]+$', '', 'g'), '[0-9_]|[\\p{L}\\p{Nd}][^\\p{L}\\p{Nd}\\s''’][\\p{L}\\p{Nd}]'))) > 0 THEN 'navigational'
  WHEN regexp_matches(lower(query), '(^|[^\\p{L}\\p{Nd}])(how|why|usually|pattern|prefer|explain|tend[^\\p{L}\\p{Nd}]+to)([^\\p{L}\\p{Nd}]|$)') THEN 'conceptual' ELSE 'factual' END AS kind FROM asked))"""
FUSED = f"""{BM25}, {VECTOR}, {INTENT},
vr AS (SELECT *, CASE WHEN CAST(score::FLOAT AS DOUBLE) >= {FLOOR} THEN row_number() OVER (PARTITION BY query_id, CAST(score::FLOAT AS DOUBLE) >= {FLOOR} ORDER BY pos) - 1 END AS vr FROM vec),
rrf AS (SELECT query_id, id, score, round(coalesce(wv / (61 + vr), 0) + coalesce(wk / (61 + kpos), 0), 12) AS rrf FROM vr FULL JOIN kw USING (query_id, id) JOIN intent USING (query_id) WHERE vr IS NOT NULL OR kpos IS NOT NULL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, coalesce(score, 0) DESC, id) - 1 AS pos FROM rrf)"""


def live(spark: SparkSession, d: str, vectors: bool = False, only: DataFrame | None = None) -> DataFrame:
    return X.mem(spark, d, vectors, only).filter("dead = 0")


def inputs(d: str) -> tuple[str, ...]:
    """The tables that memory rows are made of."""
    return tuple(f"{d}/{t}.parquet" for t in ("documents", "events", "labels"))


def postings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The index of the live rows but the raw ones, which a search over all layers leaves out."""
    rows = lambda: live(spark, d).filter("layer <> 'l2_raw'").withColumnRenamed("user_id", "owner")
    return index.postings(spark, f"rows of {d}", rows, F.lower("content"), inputs(d), T.term)


def query_terms(q: DataFrame) -> DataFrame:
    return q.select("query_id", "owner", F.explode(F.array_distinct(T.tokens("query"))).alias("term"))


def asked_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms of all queries as a table, whose size decides how the postings are joined: few terms are broadcast."""
    return index.saved(query_terms(X.asked(spark, d)), "terms")


@query(X.with_views("mem", sql=f"+{POSTINGS} SELECT id, term, tf, dl FROM postings JOIN lengths USING (owner, id)"))
def postings_index(spark: SparkSession, d: str) -> DataFrame:
    """Term counts of each row."""
    return postings(spark, d)[0].select("id", "term", "tf", "dl")


def _keyword(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(asked_terms(spark, d), *postings(spark, d), k=10 * LIMIT)


@query(X.with_views("mem", "asked", sql=f"+{BM25} SELECT query_id, id, round(kscore, 6) AS kscore, kpos FROM kw"))
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 in the owner's rows."""
    return _keyword(spark, d).withColumn("kscore", F.round("kscore", 6))


RAW_KW = _postings_sql("layer = 'l2_raw'", "_raw") + ", " + _bm25_sql("_raw")


@query(X.with_views("mem", "asked", sql=f"+{BM25}, {RAW_KW} SELECT query_id, id, round(kscore, 6) AS kscore FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kscore DESC, id) AS n FROM (SELECT query_id, id, kscore FROM kw UNION ALL SELECT query_id, id, kscore FROM kw_raw)) WHERE n <= 50"))
def keyword_with_raw(spark: SparkSession, d: str) -> DataFrame:
    """Where raw rows are searched too they are ranked by themselves, and both lists are merged by score."""
    raw = lambda: live(spark, d).filter("layer = 'l2_raw'").withColumnRenamed("user_id", "owner")
    other = R.bm25(asked_terms(spark, d), *index.postings(spark, f"raw rows of {d}", raw, F.lower("content"), inputs(d), T.term), k=10 * LIMIT)
    both = R.renumber(_keyword(spark, d).unionByName(other).drop("kpos"), F.desc("kscore"))
    return both.filter(F.col("pos") < 10 * LIMIT).select("query_id", "id", F.round("kscore", 6).alias("kscore"))


def _vector(spark: SparkSession, d: str) -> DataFrame:
    return R.vector_top(X.asked(spark, d), live(spark, d, True), 3 * LIMIT)


@query(X.with_views("mem", "asked", sql=f"+{VECTOR} SELECT query_id, id, round(score, 6) AS score, pos FROM vec"))
def vector_search(spark: SparkSession, d: str) -> DataFrame:
    """Exact nearest rows of the owner."""
    return _vector(spark, d).withColumn("score", F.round("score", 6))


def intent(query: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """kind, wv, wk of a query."""
    words = F.filter(F.split(query, " "), lambda w: w != "")
    short = F.size(words).between(1, 3) & F.exists(words, T.looks_like_identifier)
    conceptual = F.lower(query).rlike("(^|[^\\p{L}\\p{Nd}])(how|why|usually|pattern|prefer|explain|tend[^\\p{L}\\p{Nd}]+to)([^\\p{L}\\p{Nd}]|$)")
    kind = F.when(short, "navigational").when(conceptual, "conceptual").otherwise("factual")
    wv, wk = (F.when(kind == "navigational", a).when(kind == "conceptual", b).otherwise(1.0) for a, b in ((0.6, 1.15), (1.4, 0.85)))
    return kind.alias("kind"), wv.alias("wv"), wk.alias("wk")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    w = X.asked(spark, d).select("query_id", *intent(F.col("query")))
    return R.fuse(_vector(spark, d).join(w, "query_id"), _keyword(spark, d).join(w, "query_id"), FLOOR)


@query(X.with_views("mem", "asked", sql=f"+{FUSED} SELECT query_id, id, round(rrf, 6) AS rrf, pos FROM fused WHERE pos < {LIMIT}"))
def recall_minimum(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid recall, cut to the limit."""
    return _fused(spark, d).filter(F.col("pos") < LIMIT).select("query_id", "id", F.round("rrf", 6).alias("rrf"), "pos")


def candidates(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The fused hits with their rows, one of each text. The hits are stored first, so that only their rows are looked up, before any join of the tables."""
    cols = ["id", "layer", "content", "user_id", "agent_id", "ts", "session_id", "embedding", *more]
    hits = index.saved(_fused(spark, d).select("query_id", "id", "score", "pos"), "fused")
    return R.text_dedupe(hits.join(live(spark, d, True, hits).select(*cols), "id"))


DEDUPED = f"""{FUSED}, hit AS (SELECT f.query_id, f.score, f.pos AS pos0, m.* FROM fused f JOIN mem m USING (id)),
ded AS (SELECT *, min(pos0) OVER k AS p0, row_number() OVER (PARTITION BY query_id, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))) ORDER BY CASE WHEN layer = 'l1_profile' THEN 0 ELSE 1 END, pos0) AS n
  FROM hit WINDOW k AS (PARTITION BY query_id, lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))))),
cand AS (SELECT * EXCLUDE (pos0, p0, n), row_number() OVER (PARTITION BY query_id ORDER BY p0, id) - 1 AS pos FROM ded WHERE n = 1)"""


def _ranked(factor: str, source: str = "cand", out: str = "r") -> str:
    return f"{out} AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY query_id ORDER BY 1.0::DOUBLE / (60 + pos + 1) * ({factor}) DESC, pos) - 1 AS pos FROM {source})"


def ranked_sql(*stages: str) -> str:
    """cand and the stages r0, r1, ... each on the one before."""
    out, last = [DEDUPED], "cand"
    for i, f in enumerate(stages):
        out.append(_ranked(f, last, f"r{i}"))
        last = f"r{i}"
    return "+" + ", ".join(out) + " "


@query(X.with_views("mem", "asked", sql=ranked_sql() + "SELECT query_id, id, layer, pos FROM cand"))
def text_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """One hit of each text."""
    return candidates(spark, d).select("query_id", "id", "layer", "pos")


AGE = f"date_diff('second', ts, TIMESTAMP '{X.NOW}') / 86400.0::DOUBLE"
RECENCY = f"CASE WHEN layer IN ('l1_profile', 'l6_schema', 'l8_entity') OR {AGE} < 0 THEN 1 ELSE 0.92::DOUBLE + 0.08::DOUBLE * pow(2::DOUBLE, -({AGE}) / CASE WHEN layer = 'l7_intention' THEN 3 ELSE 30 END) END"
WINDOW_FACTOR = "CASE WHEN ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-03' THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END"
ENTITY_FACTOR = "CASE WHEN contains(lower(content), 'the') THEN 1.06::DOUBLE ELSE 1.0::DOUBLE END"
SESSION_FACTOR = "CASE WHEN layer <> 'l7_intention' THEN 1.0::DOUBLE WHEN session_id % 2 = 0 THEN 1.08::DOUBLE ELSE 0.95::DOUBLE END"


def age_days() -> F.Column:
    return (F.unix_timestamp(F.lit(X.NOW).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 86400.0


def window_factor():
    return F.when((F.col("ts") >= F.lit("2024-01-02").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")), 1.0).otherwise(0.85)


def recency():
    return R.recency_factor(age_days(), R.half_life_days(F.col("layer")))


@query(X.with_views("mem", "asked", sql=ranked_sql(WINDOW_FACTOR) + "SELECT query_id, id, pos FROM r0"))
def time_window_rank(spark: SparkSession, d: str) -> DataFrame:
    """Hits outside the window sink."""
    return R.stage(candidates(spark, d), window_factor()).select("query_id", "id", "pos")


@query(X.with_views("mem", "asked", sql=ranked_sql(ENTITY_FACTOR) + "SELECT query_id, id, pos FROM r0"))
def entity_boost(spark: SparkSession, d: str) -> DataFrame:
    """Hits that name an entity of the query rise."""
    return R.stage(candidates(spark, d), F.when(F.lower("content").contains("the"), 1.06).otherwise(1.0)).select("query_id", "id", "pos")


@query(X.with_views("mem", "asked", sql=ranked_sql(RECENCY) + "SELECT query_id, id, pos FROM r0"))
def recency_rank(spark: SparkSession, d: str) -> DataFrame:
    """W10."""
    return R.stage(candidates(spark, d), recency()).select("query_id", "id", "pos")


USAGE = """use AS (SELECT event_id % 200 AS uid, count(*) AS shown, count(*) FILTER (event_type = 'click') AS used, max(ts) AS last FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)"""


def usage(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events").filter(F.col("event_type").isin("view", "click"))
    return e.groupBy((F.col("event_id") % 200).alias("uid")).agg(F.count("*").alias("shown"), F.count(F.when(F.col("event_type") == "click", 1)).alias("used"), F.max("ts").alias("last"))


@query("SELECT event_id % 200 AS id, count(*) AS shown, count(*) FILTER (event_type = 'click') AS used, max(ts) AS last FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def usage_counts(spark: SparkSession, d: str) -> DataFrame:
    """A8, T8."""
    return usage(spark, d).withColumnRenamed("uid", "id")


@query(X.with_views("mem", "asked", sql=ranked_sql() + f", {USAGE}, u AS (SELECT c.*, shown, used FROM cand c LEFT JOIN use ON uid = id), " + _ranked("CASE WHEN coalesce(shown, 0) < 3 THEN 1 ELSE 0.94::DOUBLE + 0.12::DOUBLE * (used + 1) / (shown + 2) END", "u") + " SELECT query_id, id, pos FROM r"))
def usage_rank(spark: SparkSession, d: str) -> DataFrame:
    """W11."""
    c = candidates(spark, d).join(usage(spark, d), F.col("id") == F.col("uid"), "left")
    return R.stage(c, R.usage_factor(F.col("shown"), F.col("used"))).select("query_id", "id", "pos")


def session_factor():
    return F.when(F.col("layer") != "l7_intention", 1.0).when(F.col("session_id") % 2 == 0, 1.08).otherwise(0.95)


@query(X.with_views("mem", "asked", sql=ranked_sql(WINDOW_FACTOR, ENTITY_FACTOR, RECENCY, SESSION_FACTOR) + "SELECT query_id, id, pos FROM r3 WHERE pos < 10"))
def signal_cascade(spark: SparkSession, d: str) -> DataFrame:
    """W6, W8, W10, W12 in order, each from the places that the one before gave."""
    c = candidates(spark, d)
    for f in (window_factor(), F.when(F.lower("content").contains("the"), 1.06).otherwise(1.0), recency(), session_factor()):
        c = R.stage(c, f)
    return c.filter("pos < 10").select("query_id", "id", "pos")


@query(X.with_views("mem", "asked", sql=ranked_sql() + ", n AS (SELECT *, row_number() OVER (PARTITION BY query_id, layer ORDER BY pos) AS n FROM cand) SELECT query_id, id, layer, row_number() OVER (PARTITION BY query_id ORDER BY pos, id) - 1 AS pos FROM n WHERE NOT (layer = 'l5_knowledge' AND n > 2) AND NOT (layer = 'l8_entity' AND n > 2)"))
def layer_caps(spark: SparkSession, d: str) -> DataFrame:
    """At most max(1, 2 * limit // 5) knowledge rows and two entities."""
    c = R.layer_cap(candidates(spark, d), "l5_knowledge", max(1, 2 * LIMIT // 5))
    return R.layer_cap(c, "l8_entity", 2).select("query_id", "id", "layer", "pos")


@query(X.with_views("mem", "asked", sql=ranked_sql() + """, s AS (SELECT *, max(CASE WHEN pos < 5 AND layer = 'l6_schema' THEN 1 ELSE 0 END) OVER q AS has, min(CASE WHEN pos >= 5 AND layer = 'l6_schema' THEN pos END) OVER q AS pin,
 sum(CASE WHEN pos < 5 AND layer = 'l3_fact' THEN 1 ELSE 0 END) OVER q AS facts FROM cand WINDOW q AS (PARTITION BY query_id)),
 o AS (SELECT *, max(CASE WHEN pos < 5 AND layer <> 'l8_entity' AND NOT (layer = 'l3_fact' AND facts = 1) THEN pos END) OVER (PARTITION BY query_id) AS pout FROM s)
 SELECT query_id, id, layer, CASE WHEN has = 0 AND pin IS NOT NULL AND pout IS NOT NULL AND pos = pin THEN pout WHEN has = 0 AND pin IS NOT NULL AND pout IS NOT NULL AND pos = pout THEN pin ELSE pos END AS pos FROM o"""))
def layer_quota(spark: SparkSession, d: str) -> DataFrame:
    """A schema gets a place if one is among the candidates."""
    return R.ensure_layer(candidates(spark, d), "l6_schema", LIMIT).select("query_id", "id", "layer", "pos")


@query(X.with_views("mem", "asked", sql=ranked_sql() + """, v AS (SELECT query_id, id, pos FROM cand WHERE layer <> 'l7_intention'), v2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos, id) - 1 AS pos FROM v),
 e AS (SELECT query_id, id, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM cand WHERE layer = 'l7_intention'), k AS (SELECT query_id, 1 AS k FROM e GROUP BY 1),
 a AS (SELECT query_id, id, pos, CASE WHEN pos < 5 - coalesce(k, 0) THEN 0 ELSE 2 END AS o FROM v2 LEFT JOIN k USING (query_id) UNION ALL SELECT query_id, id, pos, CASE WHEN n = 1 THEN 1 ELSE 3 END FROM e)
 SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, pos, id) - 1 AS pos FROM a"""))
def place_within(spark: SparkSession, d: str) -> DataFrame:
    """Extra hits take the last visible places."""
    c = candidates(spark, d).select("query_id", "id", "layer", "pos")
    v = R.renumber(c.filter("layer <> 'l7_intention'").drop("layer"), F.col("pos"))
    return R.place_within(v, c.filter("layer = 'l7_intention'").drop("layer"), LIMIT).select("query_id", "id", "pos")


@query(X.with_views("mem", "asked", sql=ranked_sql() + """SELECT query_id, channel, count(*) AS n, array_to_string(list(CAST(id AS VARCHAR) ORDER BY pos), ',') AS ids FROM
 (SELECT *, CASE WHEN layer = 'l8_entity' THEN 'pages' WHEN layer IN ('l1_profile', 'l6_schema') THEN 'profile' WHEN layer = 'l7_intention' THEN 'proactive' ELSE 'normal' END AS channel FROM cand WHERE pos < 10) GROUP BY 1, 2"""))
def channels(spark: SparkSession, d: str) -> DataFrame:
    """Hits by channel, in order."""
    channel = F.when(F.col("layer") == "l8_entity", "pages").when(F.col("layer").isin("l1_profile", "l6_schema"), "profile").when(F.col("layer") == "l7_intention", "proactive").otherwise("normal")
    c = candidates(spark, d).filter("pos < 10").withColumn("channel", channel)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("id").cast("string").alias("id")))), lambda x: x["id"]), ",")
    return c.groupBy("query_id", "channel").agg(F.count("*").alias("n"), ids.alias("ids"))


@query(X.with_views("asked", sql=f"+{INTENT} SELECT query_id, kind, wv, wk FROM intent"))
def intent_weights(spark: SparkSession, d: str) -> DataFrame:
    """W5, X9."""
    return X.asked(spark, d).select("query_id", *intent(F.col("query")))
