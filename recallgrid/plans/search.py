"""The whole of a search, and its two greedy stages, with SQL that composes all stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.functions import text as T
from recallgrid.operators import rank as R
from recallgrid.operators import search as S
from recallgrid.plans import cascade as C
from recallgrid.plans import recall as P
from recallgrid.registry import query
from recallgrid.sources.index import saved

RULES = S.Rules(now=X.NOW, limit=P.LIMIT, floor=P.FLOOR)
NUMS = "list_sort(list_distinct(regexp_extract_all(m.content, '([0-9]+)', 1)))"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def greedy_sql(src: str, out: str, x: str = "") -> str:
    """dd: src (query_id, id, pos) with near duplicates behind; out: that in order of marginal relevance. The head is 2 * limit."""
    head = 2 * RULES.limit
    listed = lambda name, ordered: f"{name} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, pos) - 1 AS pos FROM ({ordered}))"
    return f"""hd{x} AS (SELECT s.query_id, s.pos, m.layer, m.embedding::DOUBLE[] AS e, {NUMS} AS nums FROM {src} s JOIN mem m USING (id) WHERE s.pos < {head}),
pr{x} AS (SELECT a.query_id, a.pos AS p, list(b.pos) AS near FROM hd{x} a JOIN hd{x} b ON b.query_id = a.query_id AND b.pos < a.pos AND b.nums = a.nums AND round(list_cosine_similarity(a.e, b.e), 9) >= {RULES.near} GROUP BY 1, 2),
wk{x} AS (SELECT query_id, 0::BIGINT AS p, []::BIGINT[] AS kept, []::BIGINT[] AS late FROM (SELECT DISTINCT query_id FROM hd{x})
  UNION ALL SELECT w.query_id, w.p + 1, CASE WHEN list_has_any(kept, coalesce(near, [])) THEN kept ELSE list_append(kept, w.p) END, CASE WHEN list_has_any(kept, coalesce(near, [])) THEN list_append(late, w.p) ELSE late END
  FROM wk{x} w JOIN hd{x} h ON h.query_id = w.query_id AND h.pos = w.p LEFT JOIN pr{x} r ON r.query_id = w.query_id AND r.p = w.p),
od{x} AS (SELECT query_id, list_concat(arg_max(kept, p), arg_max(late, p)) AS ord FROM wk{x} GROUP BY 1),
{listed(f"dd{x}", f"SELECT s.query_id, s.id, s.pos, CASE WHEN s.pos < {head} THEN list_position(ord, s.pos) ELSE 1000 END AS o FROM {src} s JOIN od{x} USING (query_id)")},
hm{x} AS (SELECT s.query_id, s.pos, m.layer IN ('l2_raw', 'l3_fact', 'l4_summary', 'l5_knowledge') AS may, m.embedding::DOUBLE[] AS e FROM dd{x} s JOIN mem m USING (id) WHERE s.pos < {head}),
cs{x} AS (SELECT a.query_id, a.pos, a.may, list(list_cosine_similarity(a.e, b.e) ORDER BY b.pos) AS c, count(*) AS n FROM hm{x} a JOIN hm{x} b USING (query_id) GROUP BY 1, 2, 3),
cm{x} AS (SELECT query_id, max(n) AS n, list(pos ORDER BY pos) FILTER (may) AS slots, list(c ORDER BY pos) AS c FROM cs{x} GROUP BY 1),
mr{x} AS (SELECT query_id, n, slots, c, [CASE WHEN n > 1 THEN (1.0::DOUBLE / (61 + i) - 1.0::DOUBLE / (60 + n)) / (1.0::DOUBLE / 61 - 1.0::DOUBLE / (60 + n)) ELSE 1 END FOR i IN range(n)] AS rel, slots AS left_, []::BIGINT[] AS chosen FROM cm{x} WHERE n >= 3 AND slots IS NOT NULL
  UNION ALL SELECT query_id, n, slots, c, rel, list_filter(left_, lambda i: i <> best), list_append(chosen, best)
  FROM (SELECT *, -(list_max(list_transform(left_, lambda i: {{'s': round({RULES.spread} * rel[i + 1] - {1 - RULES.spread} * greatest(0, coalesce(list_max(list_transform(chosen, lambda k: c[i + 1][k + 1])), 0)), 9), 'o': -i}}))).o AS best FROM mr{x} WHERE len(left_) > 0)),
md{x} AS (SELECT query_id, slots, chosen FROM mr{x} WHERE len(left_) = 0),
{listed(out, f"SELECT s.query_id, s.id, s.pos, CASE WHEN list_contains(chosen, s.pos) THEN slots[list_position(chosen, s.pos)] ELSE s.pos END AS o FROM dd{x} s LEFT JOIN md{x} USING (query_id)")}"""


def placed_sql(hits: str, extra: str, out: str) -> str:
    """extra: query_id, id, n (from 1)."""
    return f"""{out} AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, pos, id) - 1 AS pos FROM (
  SELECT query_id, id, pos, CASE WHEN pos < {RULES.limit} - coalesce(k, 0) THEN 0 ELSE 2 END AS o FROM {hits} LEFT JOIN (SELECT query_id, least(count(*), {RULES.room}) AS k FROM {extra} GROUP BY 1) USING (query_id)
  UNION ALL SELECT query_id, id, n, CASE WHEN n <= {RULES.room} THEN 1 ELSE 3 END FROM {extra}))"""


MERGED = f"""{P.VECTOR.replace("vec AS", "vec0 AS", 1)}, {C.CLAUSE_SQL}, vec AS (SELECT query_id, id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, id) - 1 AS pos FROM (SELECT query_id, id, score FROM vec0 UNION ALL SELECT query_id, id, score FROM clause) GROUP BY 1, 2)"""
WHOLE = f"""{P.DEDUPED.replace(P.VECTOR, MERGED)}, {C.WINDOWED[C.WINDOWED.index(C.SPAN_SQL):]}, aq AS (SELECT a.*, e.user_id AS session FROM asked a LEFT JOIN events e ON e.event_id = a.query_id),
{P._ranked("CASE WHEN f IS NULL OR (rf < t AND rt > f) THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END", "apm", "w6")}, {C.NAME_SQL},
w6n AS (SELECT w.*, EXISTS (SELECT 1 FROM ent e WHERE e.query_id = w.query_id AND list_has_all({T.tokens_sql("w.content")}, {T.tokens_sql("e.name")})) AS named FROM w6 w),
{P._ranked("CASE WHEN named THEN 1.06::DOUBLE ELSE 1.0::DOUBLE END", "w6n", "w8")},
nb AS (SELECT query_id, other FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY other) AS n FROM (SELECT DISTINCT e.query_id, n.other FROM ent e JOIN asked a USING (query_id) JOIN names n ON n.owner = a.owner AND n.name = e.name)) WHERE n <= {C.NEIGHBOURS}),
adm AS (SELECT * FROM (SELECT b.query_id, b.id, row_number() OVER (PARTITION BY b.query_id ORDER BY b.pos) AS n FROM vec b JOIN mem m USING (id) WHERE b.score >= {RULES.graph_floor} AND NOT EXISTS (SELECT 1 FROM w8 c WHERE c.query_id = b.query_id AND c.id = b.id)
  AND EXISTS (SELECT 1 FROM nb WHERE nb.query_id = b.query_id AND len({T.tokens_sql("nb.other")}) > 0 AND list_has_all({T.tokens_sql("m.content")}, {T.tokens_sql("nb.other")}))) WHERE n <= {RULES.graph_most}),
{placed_sql("w8", "adm", "w9")}, {C.LAST_USED}, {P.USAGE},
f7 AS (SELECT query_id, w.pos AS pos0, m.*, greatest(m.ts, coalesce(CASE WHEN lu.last <= TIMESTAMP '{X.NOW}' THEN lu.last END, m.ts)) AS ref, shown, used, session, row_number() OVER (PARTITION BY query_id ORDER BY w.pos) - 1 AS pos FROM w9 w JOIN mem m USING (id) JOIN aq USING (query_id) LEFT JOIN lu ON lu.uid = m.id LEFT JOIN use ON use.uid = m.id
  WHERE NOT (layer = 'l7_intention' AND CASE WHEN length(event_at) = 10 THEN TIMESTAMP '{X.NOW}' >= event_at::TIMESTAMP + INTERVAL 2 DAY WHEN length(event_at) = 7 THEN TIMESTAMP '{X.NOW}' >= (event_at || '-01')::TIMESTAMP + INTERVAL 1 MONTH + INTERVAL 1 DAY ELSE date_diff('second', m.ts, TIMESTAMP '{X.NOW}') > 7 * 86400 END)),
{P._ranked(C.RECENCY_USED, "f7", "w10")}, {P._ranked("CASE WHEN coalesce(shown, 0) < 3 THEN 1 ELSE 0.94::DOUBLE + 0.12::DOUBLE * (used + 1) / (shown + 2) END", "w10", "w11")},
{P._ranked("CASE WHEN layer <> 'l7_intention' OR session IS NULL THEN 1.0::DOUBLE WHEN session_id = session THEN 1.08::DOUBLE ELSE 0.95::DOUBLE END", "w11", "w12")},
{greedy_sql("w12", "w14")},
lk AS (SELECT query_id, h, unnest([h + 160, h + 320]) AS id, pos, unnest([1, 2]) AS k FROM (SELECT w.query_id, w.id AS h, w.pos FROM w14 w JOIN mem m USING (id) WHERE w.pos < {RULES.limit} AND layer = 'l3_fact')),
lf AS (SELECT l.query_id, l.id, min(l.pos * 10 + l.k) AS o FROM lk l JOIN asked a USING (query_id) JOIN mem m ON m.id = l.id AND m.layer = 'l3_fact' AND m.dead = 0 AND m.user_id = a.owner WHERE NOT EXISTS (SELECT 1 FROM w14 c WHERE c.query_id = l.query_id AND c.id = l.id) GROUP BY 1, 2),
ln AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o) AS n FROM lf) WHERE n <= {RULES.linked_most}),
{placed_sql("w14", "ln", "w19")},
cap AS (SELECT query_id, id, layer, user_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS pos FROM (SELECT w.query_id, w.pos, m.id, m.layer, m.user_id, row_number() OVER (PARTITION BY query_id, layer ORDER BY w.pos) AS n FROM w19 w JOIN mem m USING (id)) WHERE NOT (layer = 'l5_knowledge' AND n > {max(1, 2 * RULES.limit // 5)}) AND NOT (layer = 'l8_entity' AND n > 2)),
ev AS (SELECT s.id, s.user_id, s.ts, unnest([s.id - 60, s.id - 59, s.id - 220, s.id - 60]) AS fact FROM mem s WHERE layer = 'l6_schema' AND dead = 0),
sup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cites DESC, ts DESC, id DESC) AS n FROM (SELECT t.query_id, e.id, e.ts, count(DISTINCT e.fact) AS cites FROM cap t JOIN asked a USING (query_id) JOIN ev e ON e.fact = t.id AND e.user_id = a.owner WHERE t.pos < {RULES.limit} AND t.layer = 'l3_fact' GROUP BY 1, 2, 3)) WHERE n <= {RULES.schemas_most}),
one AS (SELECT query_id, arg_min(id, n) AS id FROM sup WHERE NOT EXISTS (SELECT 1 FROM cap c WHERE c.query_id = sup.query_id AND c.id = sup.id) GROUP BY 1),
qt AS (SELECT *, count(*) OVER q AS size, max(CASE WHEN pos < {RULES.limit} AND layer = 'l6_schema' THEN 1 ELSE 0 END) OVER q AS has, sum(CASE WHEN pos < {RULES.limit} AND layer = 'l3_fact' THEN 1 ELSE 0 END) OVER q AS facts FROM cap WINDOW q AS (PARTITION BY query_id)),
qo AS (SELECT query_id, CASE WHEN max(size) < {RULES.limit} THEN max(size) ELSE max(CASE WHEN pos < {RULES.limit} AND layer <> 'l8_entity' AND NOT (layer = 'l3_fact' AND facts = 1) THEN pos END) END AS pos FROM qt WHERE has = 0 GROUP BY 1),
add_ AS (SELECT query_id, id, pos FROM one JOIN qo USING (query_id) WHERE pos IS NOT NULL),
fin AS (SELECT query_id, id, pos FROM cap WHERE NOT EXISTS (SELECT 1 FROM add_ a WHERE a.query_id = cap.query_id AND a.pos = cap.pos) UNION ALL SELECT * FROM add_)"""
CHANNEL = "CASE WHEN layer = 'l8_entity' THEN 'pages' WHEN layer IN ('l1_profile', 'l6_schema') THEN 'profile' WHEN layer = 'l7_intention' THEN 'proactive' WHEN layer = 'l3_fact' AND label = 'experience' THEN 'experiences' ELSE 'normal' END"


def store(spark: SparkSession, d: str) -> S.Store:
    rows = saved(P.live(spark, d, True).drop("content"), "rows")
    texts = X.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    text = F.concat((F.col("id") + 160).cast("string"), F.lit(":Related, bad, x:unknown,"), (F.col("id") + 320).cast("string"), F.lit(":contrasts"))
    links = rows.filter("layer = 'l3_fact'").select("id", F.posexplode(T.links(text)).alias("k", "l")).select("id", "k", F.expr("try_cast(l.id as bigint)").alias("to"))
    ev = F.array_distinct(F.array(F.col("id") - 60, F.col("id") - 59, F.col("id") - 220, F.col("id") - 60))
    evidence = rows.filter("layer = 'l6_schema'").select("id", F.col("user_id").alias("owner"), "ts", F.explode(ev).alias("fact"))
    return S.Store(rows, *P.postings(spark, d), C.clause_vectors(spark, d), P.usage(spark, d).withColumnRenamed("uid", "id"), links, evidence, texts)


def search_queries(spark: SparkSession, d: str) -> DataFrame:
    """All queries with weights by intent, the asked window, the session, identifiers, named entities and their neighbours."""
    q = X.asked(spark, d)
    words = F.filter(F.split("query", " "), lambda w: w != "")
    ident = F.when(F.size(words) <= 3, F.flatten(F.transform(F.filter(words, T.looks_like_identifier), lambda w: F.array(w))))
    q = q.select("*", *P.intent(F.col("query"))[1:], F.array_join(F.coalesce(ident, F.array().cast("array<string>")), " ").alias("it")).withColumn("identifiers", F.array_distinct(T.tokens("it"))).drop("it")
    q = q.join(X.table(spark, d, "events").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("session")), "query_id", "left")
    q = q.join(C.windows(spark, d).select("query_id", "f", "t"), "query_id", "left")
    e = C.entities(spark, d)
    near = e.select("query_id", "other").distinct().withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("other"))).filter(F.col("n") <= C.NEIGHBOURS)
    q = q.join(e.groupBy("query_id").agg(F.collect_set(T.tokens("name")).alias("names")), "query_id", "left")
    return saved(q.join(near.groupBy("query_id").agg(F.collect_set(T.tokens("other")).alias("neighbours")), "query_id", "left"), "queries")


@query(recursive(X.with_views("mem", "asked", sql=f"+{WHOLE} SELECT query_id, pos, id, layer, {CHANNEL} AS channel FROM fin JOIN mem USING (id) WHERE pos < {RULES.limit}")))
def search(spark: SparkSession, d: str) -> DataFrame:
    """W1-W21 as one search: W1, J3, W2-W5, F6, J15, J4, W6-W9, F7, W10-W14, W19, W15, W18, W17, cut, channel."""
    q = search_queries(spark, d)
    hits = S.search(q, saved(P.query_terms(q), "terms"), store(spark, d), RULES, saved)
    channel = F.when(F.col("layer") == "l8_entity", "pages").when(F.col("layer").isin("l1_profile", "l6_schema"), "profile").when(F.col("layer") == "l7_intention", "proactive").when((F.col("layer") == "l3_fact") & (F.col("label") == "experience"), "experiences").otherwise("normal")
    hits = saved(hits, "hits")
    rows = P.live(spark, d, only=hits).select("id", F.col("label").alias("own"))
    return hits.join(rows, "id").withColumn("label", F.coalesce("label", "own")).select("query_id", "pos", "id", "layer", channel.alias("channel"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    from recallgrid.functions.vector import unit

    return P.candidates(spark, d).select("query_id", "id", "pos", "layer", unit(F.col("embedding")).alias("u"), T.digit_runs(F.col("content")).alias("nums"))


@query(recursive(X.with_views("mem", "asked", sql=f"{P.ranked_sql()}, {greedy_sql('cand', 'mm')} SELECT query_id, id, pos FROM dd")))
def near_duplicates_last(spark: SparkSession, d: str) -> DataFrame:
    """Near duplicates of a kept hit, with the same numbers, go behind the head's kept ones; a fold in the JVM."""
    return S.folded(_heads(spark, d), RULES.limit, S.duplicates_last(RULES.near)).select("query_id", "id", "pos")


@query(recursive(X.with_views("mem", "asked", sql=f"{P.ranked_sql()}, {greedy_sql('cand', 'mm')} SELECT query_id, id, pos FROM mm")))
def mmr_rank(spark: SparkSession, d: str) -> DataFrame:
    """W14, after W13: marginal relevance over the head, as a fold in the JVM."""
    return S.folded(_heads(spark, d), RULES.limit, S.duplicates_last(RULES.near), S.spread(RULES.spread)).select("query_id", "id", "pos")


@query()
def recall(spark: SparkSession, d: str) -> DataFrame:
    """A shorter cascade over the fused hits, with fixed signals: W1-W4, W6, W8, F7, W10-W15, W17, cut."""
    from recallgrid.functions.vector import unit

    c = P.candidates(spark, d).join(P.usage(spark, d), F.col("id") == F.col("uid"), "left")
    c = c.withColumns({"u": unit(F.col("embedding")), "nums": T.digit_runs(F.col("content"))})
    c = R.stage(R.stage(c, P.window_factor()), F.when(F.lower("content").contains("the"), 1.06).otherwise(1.0))
    c = R.renumber(c.filter(F.expr("not (layer = 'l7_intention' and ts < timestamp_ntz'2024-01-02 12:00:00')")), F.col("pos"))
    for f in (P.recency(), R.usage_factor(F.col("shown"), F.col("used")), P.session_factor()):
        c = R.stage(c, f)
    c = S.folded(c.select("query_id", "pos", "id", "layer", "score", "content", "u", "nums"), RULES.limit, S.duplicates_last(RULES.near), S.spread(RULES.spread))
    c = R.layer_cap(R.layer_cap(c, "l5_knowledge", 2), "l8_entity", 2)
    c = R.ensure_layer(R.ensure_layer(c, "l6_schema", RULES.limit), "l7_intention", RULES.limit)
    return c.filter(F.col("pos") < RULES.limit).select("query_id", "pos", "id", "layer", F.round("score", 6).alias("score"), "content")
