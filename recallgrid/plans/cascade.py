"""What a search adds to the fused hits: clauses, time windows, entities, graph neighbours, links, evidence, history."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.functions import text as T
from recallgrid.functions import timewin
from recallgrid.functions.vector import cosine
from recallgrid.operators import rank as R
from recallgrid.operators import search as S
from recallgrid.plans import recall as P
from recallgrid.registry import query
from recallgrid.sources.index import saved

LIMIT, FLOOR = P.LIMIT, P.FLOOR
#: Relaxed floors of dated facts and of facts that name a graph neighbour.
WINDOW_FLOOR, GRAPH_FLOOR = max(FLOOR - 0.20, 0.0), FLOOR - 0.10
WINDOW_SCAN, GRAPH_MOST, NEIGHBOURS, ENTITIES, LINKED, SCHEMAS = 500, 3, 10, 5, 2, 2
CLAUSES = 3
PHRASES = ("on 2024-01-05", "in 2024-01", "what happened last week", "last 2 weeks", "and nothing dated")

# --- views: clause vectors, dated queries, entity names, graph ------------------------------------

FACTS = "facts AS (SELECT * FROM mem WHERE layer = 'l3_fact' AND dead = 0)"
CLAUSE_SQL = f"""{FACTS}, cl AS (SELECT parent, user_id, embedding FROM (SELECT id AS parent, user_id, unnest(range({CLAUSES})) AS n FROM facts WHERE length(content) > 300) c JOIN embeddings ON vec_id = (parent * 7 + n) % (SELECT count(*) FROM embeddings)),
clause AS (SELECT * FROM (SELECT query_id, parent AS id, round(max(list_cosine_similarity(q_embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(max(list_cosine_similarity(q_embedding::DOUBLE[], embedding::DOUBLE[])), 9) DESC, parent) AS n FROM asked JOIN cl ON user_id = owner GROUP BY 1, 2) WHERE n <= 15)"""
BEST_SQL = f"{P.VECTOR}, {CLAUSE_SQL}, best AS (SELECT query_id, id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, id) - 1 AS pos FROM (SELECT query_id, id, score FROM vec UNION ALL SELECT query_id, id, score FROM clause) GROUP BY 1, 2)"
#: The spans that the phrases mean on 2024-02-01, a Thursday, written out.
SPAN_SQL = f"""win AS (SELECT query_id, q_embedding, owner, f, t FROM asked JOIN (VALUES (0, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06'), (1, TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01'), (2, TIMESTAMP '2024-01-22', TIMESTAMP '2024-01-29'), (3, TIMESTAMP '2024-01-18', TIMESTAMP '2024-02-02')) v(k, f, t) ON query_id % {len(PHRASES)} = k)"""
RANGE_SQL = """CASE WHEN length(event_at) = 10 THEN event_at::TIMESTAMP WHEN length(event_at) = 7 THEN (event_at || '-01')::TIMESTAMP ELSE ts END AS rf, CASE WHEN length(event_at) = 10 THEN event_at::TIMESTAMP + INTERVAL 1 DAY WHEN length(event_at) = 7 THEN (event_at || '-01')::TIMESTAMP + INTERVAL 1 MONTH ELSE ts + INTERVAL 1 SECOND END AS rt"""
NAME_SQL = f"""word AS (SELECT query_id, query, owner FROM asked), names AS (SELECT DISTINCT owner, w[1] AS name, w[2] AS other FROM (SELECT user_id AS owner, list_filter(string_split(content, ' '), lambda w: length(w) BETWEEN 3 AND 5) AS w FROM mem WHERE layer = 'l8_entity' AND dead = 0) WHERE len(w) >= 2),
ent AS (SELECT query_id, name FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY strlen(name) DESC, name) AS n FROM (SELECT DISTINCT query_id, n.name FROM word q JOIN names n USING (owner) WHERE len({T.tokens_sql('n.name')}) > 0 AND list_has_all({T.tokens_sql('q.query')}, {T.tokens_sql('n.name')}))) WHERE n <= {ENTITIES})"""


def clause_vectors(spark: SparkSession, d: str) -> DataFrame:
    """parent, user_id, embedding: search-only rows of the clauses of long facts."""
    long = P.live(spark, d).filter("layer = 'l3_fact' and length(content) > 300").select(F.col("id").alias("parent"), "user_id", F.explode(F.sequence(F.lit(0), F.lit(CLAUSES - 1))).alias("n"))
    return X.with_vectors(long, spark, d, F.col("parent") * 7 + F.col("n"))


def clause_top(spark: SparkSession, d: str) -> DataFrame:
    """query_id, id, score: parents by their best clause; clause search sees no rows of nobody."""
    return S.clause_hits(X.asked(spark, d), clause_vectors(spark, d), 3 * LIMIT)


def vector_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_best(P._vector(spark, d), clause_top(spark, d))


def windows(spark: SparkSession, d: str) -> DataFrame:
    """query_id, owner, q_embedding, f, t of queries that name a time; the phrases are parsed once each, on the driver."""
    now = datetime.fromisoformat(X.NOW).replace(tzinfo=timezone.utc)
    spans = [(i, *timewin.parse(p, now)) for i, p in enumerate(PHRASES) if timewin.parse(p, now)]
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), *[F.lit(x.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz").alias(c) for x, c in ((a, "f"), (b, "t"))]) for i, a, b in spans]))
    known = F.broadcast(spark.range(1).select(rows.alias("x")).select("x.*"))
    return X.asked(spark, d).withColumn("k", F.col("query_id") % len(PHRASES)).join(known, "k").select("query_id", "owner", "q_embedding", "f", "t")


def time_range() -> tuple[F.Column, F.Column]:
    """[from, to) of a row: its event date, to the day or the month, or else the second it was written."""
    a, b = T.event_span(F.col("event_at"))
    return F.coalesce(a.cast("timestamp_ntz"), F.col("ts")), F.coalesce(b.cast("timestamp_ntz"), F.col("ts") + F.expr("interval 1 second"))


def window_facts(spark: SparkSession, d: str) -> DataFrame:
    """query_id, id, score, pos: the best facts in a query's window, of its newest WINDOW_SCAN."""
    a, b = time_range()
    facts = P.live(spark, d, True).filter("layer = 'l3_fact'").select("id", F.col("user_id").alias("owner"), "ts", "embedding", a.alias("rf"), b.alias("rt"))
    inside = windows(spark, d).join(facts, "owner").filter((F.col("rf") < F.col("t")) & (F.col("rt") > F.col("f")))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ts"), F.desc("id")))
    inside = inside.withColumn("n", n).filter(F.col("n") <= WINDOW_SCAN).withColumn("score", F.round(cosine(F.col("q_embedding"), F.col("embedding")), 9)).filter(F.col("score") >= WINDOW_FLOOR)
    return R.renumber(inside.select("query_id", "id", "score"), F.desc("score")).filter(F.col("pos") < LIMIT)


def entity_names(spark: SparkSession, d: str) -> DataFrame:
    """owner, name, other: the owner's entity pages by name, and the name that the graph links to each (here the first two short words of a page)."""
    w = F.filter(F.split("content", " "), lambda w: F.length(w).between(3, 5))
    p = P.live(spark, d).filter("layer = 'l8_entity'").select(F.col("user_id").alias("owner"), w.alias("w")).filter("size(w) >= 2")
    return p.select("owner", F.get("w", F.lit(0)).alias("name"), F.get("w", F.lit(1)).alias("other")).distinct()


def entities(spark: SparkSession, d: str) -> DataFrame:
    """query_id, name, other: the owner's entities that a query names, the longest ENTITIES, and what the graph links them to.

    A name is found by its first token, so a query meets only the names that share one with it.
    """
    q = X.asked(spark, d).select("query_id", "owner", T.tokens("query").alias("qt")).withColumn("first", F.explode(F.array_distinct("qt")))
    names = entity_names(spark, d).withColumn("nt", T.tokens("name")).withColumn("first", F.get("nt", F.lit(0)))
    hit = q.join(names, ["owner", "first"]).filter(F.size(F.array_except("nt", "qt")) == 0)
    n = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc(F.octet_length("name")), "name"))
    return hit.withColumn("n", n).filter(F.col("n") <= ENTITIES).select("query_id", "name", "other")


def mentions(hits: DataFrame, names: DataFrame) -> DataFrame:
    """hits (query_id, content) with named: whether the content holds every token of a name of its query."""
    n = names.groupBy("query_id").agg(F.collect_set(T.tokens("name")).alias("_names"))
    h = hits.join(n, "query_id", "left").withColumn("_t", T.tokens("content"))
    return h.withColumn("named", F.coalesce(F.exists("_names", lambda x: (F.size(x) > 0) & (F.size(F.array_except(x, F.col("_t"))) == 0)), F.lit(False))).drop("_names", "_t")


# --- queries -----------------------------------------------------------------------------------


@query(X.with_views("mem", "asked", sql=f"+{CLAUSE_SQL} SELECT query_id, id, round(score, 6) AS score FROM clause"))
def clause_hits(spark: SparkSession, d: str) -> DataFrame:
    """Facts found by their best clause."""
    return clause_top(spark, d).withColumn("score", F.round("score", 6))


@query(X.with_views("mem", "asked", sql=f"+{BEST_SQL} SELECT query_id, id, round(score, 6) AS score, pos FROM best"))
def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Vector and clause hits, each row at its better score, best first."""
    return vector_candidates(spark, d).withColumn("score", F.round("score", 6))


WINDOWED = f"""{P.ranked_sql()[1:]}, {FACTS}, {SPAN_SQL},
wf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS pos FROM (SELECT query_id, id, round(list_cosine_similarity(q_embedding::DOUBLE[], embedding::DOUBLE[]), 9) AS score
  FROM (SELECT w.query_id, w.q_embedding, x.id, x.embedding, row_number() OVER (PARTITION BY w.query_id ORDER BY x.ts DESC, x.id DESC) AS n FROM win w JOIN (SELECT *, {RANGE_SQL} FROM facts) x ON x.user_id = w.owner AND x.rf < w.t AND x.rt > w.f) WHERE n <= {WINDOW_SCAN}) WHERE score >= {WINDOW_FLOOR}) WHERE pos < {LIMIT}),
app AS (SELECT query_id, id, 0 AS o, pos FROM cand UNION ALL SELECT query_id, id, 1, pos FROM wf WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.query_id = wf.query_id AND c.id = wf.id)),
ap AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, pos, id) - 1 AS pos FROM app),
apm AS (SELECT a.query_id, a.pos, m.*, w.f, w.t, {RANGE_SQL} FROM ap a JOIN mem m USING (id) LEFT JOIN win w USING (query_id))"""


def _windowed(spark: SparkSession, d: str) -> DataFrame:
    c = P.candidates(spark, d).select("query_id", "id", "score", "pos")
    c = saved(R.append_new(c, window_facts(spark, d)), "windowed")
    a, b = time_range()
    rows = c.join(P.live(spark, d, only=c).drop("dead"), "id").join(windows(spark, d).select("query_id", "f", "t"), "query_id", "left")
    miss = F.col("f").isNotNull() & ~((a < F.col("t")) & (b > F.col("f")))
    return R.stage(rows, F.when(miss, 0.85).otherwise(1.0))


@query(X.with_views("mem", "asked", sql=f"+{WINDOWED}, {P._ranked('CASE WHEN f IS NULL OR (rf < t AND rt > f) THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END', 'apm', 'r')} SELECT query_id, id, pos FROM r"))
def window_recall(spark: SparkSession, d: str) -> DataFrame:
    """Facts dated in the asked window join the hits; hits outside it sink."""
    return _windowed(spark, d).select("query_id", "id", "pos")


@query(X.with_views("mem", "asked", sql=f"+{P.ranked_sql()[1:]}, {NAME_SQL}, hitn AS (SELECT c.*, EXISTS (SELECT 1 FROM ent e WHERE e.query_id = c.query_id AND list_has_all({T.tokens_sql('c.content')}, {T.tokens_sql('e.name')})) AS named FROM cand c), {P._ranked('CASE WHEN named THEN 1.06::DOUBLE ELSE 1.0::DOUBLE END', 'hitn', 'r')} SELECT query_id, id, pos FROM r"))
def entity_recall(spark: SparkSession, d: str) -> DataFrame:
    """Hits that name an entity which the query names rise."""
    return R.stage(mentions(P.candidates(spark, d), entities(spark, d)), F.when(F.col("named"), 1.06).otherwise(1.0)).select("query_id", "id", "pos")


@query(X.with_views("mem", "asked", sql=f"""+{P.ranked_sql()[1:]}, {CLAUSE_SQL}, best AS (SELECT query_id, id, max(score) AS score, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, id) - 1 AS pos FROM (SELECT query_id, id, score FROM vec UNION ALL SELECT query_id, id, score FROM clause) GROUP BY 1, 2), {NAME_SQL},
nb AS (SELECT query_id, other FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY other) AS n FROM (SELECT DISTINCT e.query_id, n.other FROM ent e JOIN asked a USING (query_id) JOIN names n ON n.owner = a.owner AND n.name = e.name)) WHERE n <= {NEIGHBOURS}),
adm AS (SELECT * FROM (SELECT b.query_id, b.id, b.pos, row_number() OVER (PARTITION BY b.query_id ORDER BY b.pos) AS n FROM best b JOIN mem m USING (id) WHERE b.score >= {GRAPH_FLOOR} AND NOT EXISTS (SELECT 1 FROM cand c WHERE c.query_id = b.query_id AND c.id = b.id)
  AND EXISTS (SELECT 1 FROM nb WHERE nb.query_id = b.query_id AND len({T.tokens_sql('nb.other')}) > 0 AND list_has_all({T.tokens_sql('m.content')}, {T.tokens_sql('nb.other')}))) WHERE n <= {GRAPH_MOST})
SELECT query_id, id, n - 1 AS pos FROM adm"""))
def graph_admission(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that the floor left out and that name a graph neighbour of the query's entities."""
    e = entities(spark, d)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("name"))
    near = e.select("query_id", F.col("other").alias("name")).distinct().withColumn("n", n).filter(F.col("n") <= NEIGHBOURS).drop("n")
    c = vector_candidates(spark, d).filter(F.col("score") >= GRAPH_FLOOR).join(P.candidates(spark, d).select("query_id", "id"), ["query_id", "id"], "left_anti")
    c = saved(c.join(near.select("query_id").distinct(), "query_id", "left_semi"), "admissible")
    c = mentions(c.join(P.live(spark, d, only=c).select("id", "content"), "id"), near).filter("named")
    return R.renumber(c.select("query_id", "id", "pos"), F.col("pos")).filter(F.col("pos") < GRAPH_MOST)


@query(X.with_views("mem", "asked", sql=f"+{P.ranked_sql()[1:]} SELECT query_id, id FROM cand WHERE NOT (layer = 'l7_intention' AND CASE WHEN length(event_at) = 10 THEN TIMESTAMP '{X.NOW}' >= event_at::TIMESTAMP + INTERVAL 2 DAY WHEN length(event_at) = 7 THEN TIMESTAMP '{X.NOW}' >= (event_at || '-01')::TIMESTAMP + INTERVAL 1 MONTH + INTERVAL 1 DAY ELSE date_diff('second', ts, TIMESTAMP '{X.NOW}') > 7 * 86400 END)"))
def stale_intentions(spark: SparkSession, d: str) -> DataFrame:
    """dated intentions stay until a day after their due span, others for seven days."""
    _, due = T.event_span(F.col("event_at"))
    now = F.lit(X.NOW).cast("timestamp_ntz")
    old = F.when(due.isNotNull(), now >= due.cast("timestamp_ntz") + F.expr("interval 1 day")).otherwise(F.expr(f"timestampdiff(SECOND, ts, timestamp_ntz'{X.NOW}') > 7 * 86400"))
    c = P.candidates(spark, d, "event_at")
    return c.filter(~((F.col("layer") == "l7_intention") & old)).select("query_id", "id")


LAST_USED = "lu AS (SELECT event_id % 200 AS uid, max(ts) AS last FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)"
RECENCY_USED = f"""CASE WHEN layer IN ('l1_profile', 'l6_schema', 'l8_entity') OR ref >= TIMESTAMP '{X.NOW}' THEN 1 ELSE 0.92::DOUBLE + 0.08::DOUBLE * pow(2::DOUBLE, -date_diff('second', ref, TIMESTAMP '{X.NOW}') / 86400.0::DOUBLE / CASE WHEN layer = 'l7_intention' THEN 3 WHEN layer = 'l3_fact' AND label IN ('user_preferences', 'decision', 'technical_lesson', 'negative_knowledge') THEN 180 ELSE 30 END) END"""


@query(X.with_views("mem", "asked", sql=f"+{P.ranked_sql()[1:]}, {LAST_USED}, cu AS (SELECT c.*, greatest(c.ts, coalesce(CASE WHEN last <= TIMESTAMP '{X.NOW}' THEN last END, c.ts)) AS ref FROM cand c LEFT JOIN lu ON uid = id), {P._ranked(RECENCY_USED, 'cu', 'r')} SELECT query_id, id, pos FROM r"))
def recency_by_use(spark: SparkSession, d: str) -> DataFrame:
    """Age from the later of written and last used; durable facts fade in 180 days."""
    used = P.usage(spark, d).select(F.col("uid").alias("id"), "last")
    c = P.candidates(spark, d, "label").join(used, "id", "left")
    now = F.lit(X.NOW).cast("timestamp_ntz")
    ref = F.greatest("ts", F.coalesce(F.when(F.col("last") <= now, F.col("last")), F.col("ts")))
    durable = (F.col("layer") == "l3_fact") & F.col("label").isin("user_preferences", "decision", "technical_lesson", "negative_knowledge")
    half = F.when(durable, 180.0).otherwise(R.half_life_days(F.col("layer")))
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ref.cast("timestamp"))) / 86400.0
    return R.stage(c, R.recency_factor(age, half)).select("query_id", "id", "pos")


@query(X.with_views("mem", "asked", sql=f"+{P.ranked_sql()[1:]} SELECT query_id, id FROM cand WHERE label <> 'experience'"))
def without_label(spark: SparkSession, d: str) -> DataFrame:
    """hits of a label are left out."""
    return P.candidates(spark, d, "label").filter("label <> 'experience'").select("query_id", "id")


@query(X.with_views("mem", sql="SELECT id, user_id FROM mem WHERE layer = 'l3_fact' AND dead = 0 AND label = 'experience'"))
def experiences(spark: SparkSession, d: str) -> DataFrame:
    """facts that are experiences."""
    return P.live(spark, d).filter("layer = 'l3_fact' and label = 'experience'").select("id", "user_id")


EVIDENCE = f"""ev AS (SELECT s.id, s.user_id, s.ts, unnest([s.id - 60, s.id - 59, s.id - 220, s.id - 60]) AS fact FROM mem s WHERE layer = 'l6_schema' AND dead = 0),
top AS (SELECT query_id, id FROM cand WHERE pos < {LIMIT} AND layer = 'l3_fact'),
sup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cites DESC, ts DESC, id DESC) AS n FROM (SELECT t.query_id, e.id, e.ts, count(DISTINCT e.fact) AS cites FROM top t JOIN ev e ON e.fact = t.id JOIN asked a ON a.query_id = t.query_id AND a.owner = e.user_id GROUP BY 1, 2, 3)) WHERE n <= {SCHEMAS})"""


def supporting(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """query_id, id, cites, n: schemas of the query's owner that cite facts among the first LIMIT hits."""
    ev = F.array_distinct(F.array(F.col("id") - 60, F.col("id") - 59, F.col("id") - 220, F.col("id") - 60))
    e = P.live(spark, d).filter("layer = 'l6_schema'").select("id", F.col("user_id").alias("owner"), "ts", F.explode(ev).alias("fact"))
    top = hits.filter((F.col("pos") < LIMIT) & (F.col("layer") == "l3_fact")).select("query_id", F.col("id").alias("fact")).join(X.asked(spark, d).select("query_id", "owner"), "query_id")
    c = top.join(e, ["fact", "owner"]).groupBy("query_id", "id", "ts").agg(F.countDistinct("fact").alias("cites"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cites"), F.desc("ts"), F.desc("id")))
    return c.withColumn("n", n).filter(F.col("n") <= SCHEMAS).select("query_id", "id", "cites", "n")


@query(X.with_views("mem", "asked", sql=f"+{P.ranked_sql()[1:]}, {EVIDENCE} SELECT query_id, id, cites, n FROM sup"))
def evidence_schemas(spark: SparkSession, d: str) -> DataFrame:
    """The two schemas that cite most of the facts found, the newest first among equals."""
    return supporting(spark, d, P.candidates(spark, d))


LINKS_SQL = f"""lk AS (SELECT query_id, h, unnest([h + 160, h + 320]) AS id, pos, unnest([1, 2]) AS k FROM (SELECT query_id, id AS h, pos FROM cand WHERE pos < {LIMIT} AND layer = 'l3_fact')),
lf AS (SELECT l.query_id, l.id, min(l.pos * 10 + l.k) AS o FROM lk l JOIN asked a USING (query_id) JOIN mem m ON m.id = l.id AND m.layer = 'l3_fact' AND m.dead = 0 AND m.user_id = a.owner WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.query_id = l.query_id AND c.id = l.id) GROUP BY 1, 2),
ln AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o) AS n FROM lf) WHERE n <= {LINKED})"""


def linked(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """query_id, id, pos: live facts of the owner that the first LIMIT hits link to, in that order, LINKED at most."""
    text = F.concat((F.col("id") + 160).cast("string"), F.lit(":Related, bad, x:unknown,"), (F.col("id") + 320).cast("string"), F.lit(":contrasts"))
    top = hits.filter((F.col("pos") < LIMIT) & (F.col("layer") == "l3_fact")).select("query_id", F.col("pos").alias("p"), F.posexplode(T.links(text)).alias("k", "l"))
    to = top.select("query_id", "p", "k", F.expr("try_cast(l.id as bigint)").alias("id")).join(X.asked(spark, d).select("query_id", F.col("owner").alias("user_id")), "query_id")
    to = saved(to, "linked")
    to = to.join(P.live(spark, d, only=to).filter("layer = 'l3_fact'").select("id", "user_id"), ["id", "user_id"]).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    first = to.groupBy("query_id", "id").agg(F.min(F.col("p") * 10 + F.col("k")).alias("o"))
    return R.renumber(first, F.col("o")).filter(F.col("pos") < LINKED).drop("o")


@query(X.with_views("mem", "asked", sql=f"""+{P.ranked_sql()[1:]}, {LINKS_SQL}, k AS (SELECT query_id, least(count(*), {max(1, LIMIT // 3)}) AS k FROM ln GROUP BY 1),
a AS (SELECT query_id, id, pos, CASE WHEN pos < {LIMIT} - coalesce(k, 0) THEN 0 ELSE 2 END AS o FROM cand LEFT JOIN k USING (query_id) UNION ALL SELECT query_id, id, n, CASE WHEN n <= {max(1, LIMIT // 3)} THEN 1 ELSE 3 END FROM ln)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o, pos, id) - 1 AS pos FROM a"""))
def link_admission(spark: SparkSession, d: str) -> DataFrame:
    """Linked facts take the last visible places, at most a third; the others follow all hits."""
    c = saved(P.candidates(spark, d).select("query_id", "id", "layer", "pos"), "candidates")
    return R.place_within(c.drop("layer"), linked(spark, d, c), LIMIT).select("query_id", "id", "pos")


@query(X.with_views("mem", "retired", sql="""SELECT id, old_id, k, line, CASE WHEN event_at <> '' THEN event_at ELSE strftime(ts, '%Y-%m-%d') END AS date FROM (SELECT r.superseded_by AS id, r.id AS old_id, m.ts, m.event_at, row_number() OVER (PARTITION BY r.superseded_by ORDER BY m.ts DESC, r.id DESC) AS k,
 CASE WHEN strlen(m.content) <= 200 THEN m.content ELSE concat((SELECT string_agg(c, '' ORDER BY i) FROM (SELECT c, i, sum(strlen(c)) OVER (ORDER BY i) AS n FROM (SELECT unnest(string_split(substr(m.content, 1, 200), '')) AS c, generate_subscripts(string_split(substr(m.content, 1, 200), ''), 1) AS i)) WHERE n <= 200), '…') END AS line FROM retired r JOIN mem m USING (id)) WHERE k <= 2"""))
def history_lines(spark: SparkSession, d: str) -> DataFrame:
    """The two newest rows that a row replaced, their text of at most 200 bytes and their date."""
    r = X.retired(spark, d).join(X.mem(spark, d).select("id", "ts", "content", "event_at"), "id")
    k = F.row_number().over(Window.partitionBy("superseded_by").orderBy(F.desc("ts"), F.desc("id")))
    date = F.when(F.col("event_at") != "", F.col("event_at")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return r.withColumn("k", k).filter("k <= 2").select(F.col("superseded_by").alias("id"), F.col("id").alias("old_id"), "k", T.cut_bytes(F.col("content"), 200).alias("line"), date.alias("date"))


@query(X.with_views("mem", "asked", sql=P.ranked_sql() + """, ch AS (SELECT *, CASE WHEN layer = 'l8_entity' THEN 'pages' WHEN layer IN ('l1_profile', 'l6_schema') THEN 'profile' WHEN layer = 'l7_intention' THEN 'proactive' WHEN layer = 'l3_fact' AND label = 'experience' THEN 'experiences' ELSE 'normal' END AS channel FROM cand WHERE pos < 10)
 SELECT query_id, channel, list_position(['now', 'pages', 'profile', 'proactive', 'experiences', 'normal'], channel) AS place, array_to_string(list(CAST(id AS VARCHAR) ORDER BY pos), ',') AS ids FROM ch GROUP BY 1, 2"""))
def channel_order(spark: SparkSession, d: str) -> DataFrame:
    """Hits by channel, experiences apart, and the channel's place."""
    order = F.array(*map(F.lit, ("now", "pages", "profile", "proactive", "experiences", "normal")))
    c = P.candidates(spark, d, "label").filter("pos < 10")
    channel = F.when(F.col("layer") == "l8_entity", "pages").when(F.col("layer").isin("l1_profile", "l6_schema"), "profile").when(F.col("layer") == "l7_intention", "proactive").when((F.col("layer") == "l3_fact") & (F.col("label") == "experience"), "experiences").otherwise("normal")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("id").cast("string").alias("id")))), lambda x: x["id"]), ",")
    return c.withColumn("channel", channel).groupBy("query_id", "channel").agg(F.array_position(order, F.first("channel")).alias("place"), ids.alias("ids"))
