"""Scans, lookups, filters, lists and set operations over memory rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.functions import text as T
from recallgrid.registry import query
from recallgrid.sources import index

M = "mem"


def _q(sql: str) -> str:
    return X.with_views(M, sql=sql)


def live(spark: SparkSession, d: str) -> DataFrame:
    return X.mem(spark, d).filter("dead = 0")


@query(_q("SELECT id, content FROM mem WHERE layer = 'l3_fact' AND dead = 0 AND user_id IN ('src0', 'src1', 'src2') AND agent_id = 'en'"))
def layer_scan(spark: SparkSession, d: str) -> DataFrame:
    """Live rows of a layer, owners and agent."""
    return live(spark, d).filter((F.col("layer") == "l3_fact") & F.col("user_id").isin("src0", "src1", "src2") & (F.col("agent_id") == "en")).select("id", "content")


@query(_q("SELECT id, row_number() OVER (ORDER BY ts DESC, id DESC) AS pos FROM mem WHERE layer = 'l2_raw' AND dead = 0 QUALIFY pos <= 50"))
def newest_first(spark: SparkSession, d: str) -> DataFrame:
    """S3, K2: newest rows of a layer; the limit runs in each map task first."""
    top = live(spark, d).filter("layer = 'l2_raw'").orderBy(F.desc("ts"), F.desc("id")).limit(50)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("id"))).alias("pos"))


WANTED = [7, 3, 999999, 42, 3, 11]


@query(_q("SELECT p.pos, m.id, m.layer FROM (SELECT unnest([7, 3, 999999, 42, 3, 11]) AS id, unnest(range(6)) AS pos) p JOIN mem m USING (id)"))
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows by a list of ids, in its order; missing ones are skipped."""
    ids = spark.range(1).select(F.posexplode(F.array(*map(F.lit, WANTED))).alias("pos", "id"))
    return F.broadcast(ids).join(X.mem(spark, d), "id").select("pos", "id", "layer")


@query("SELECT vec_id AS id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS norm2 FROM embeddings WHERE vec_id IN (1, 5, 9, 400)")
def vector_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by id and their squared length."""
    from recallgrid.functions.vector import dot

    e = X.table(spark, d, "embeddings").filter(F.col("vec_id").isin(1, 5, 9, 400))
    return e.select(F.col("vec_id").alias("id"), F.size("embedding").cast("long").alias("n"), F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"))


@query("SELECT query_id, id, score FROM (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) DESC, r.vec_id) AS n FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0) WHERE n <= 10")
def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """W1 without owners: every vector whose id is divisible by 20 asks all of them."""
    from recallgrid.operators.rank import vector_top

    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit("").alias("user_id"), "embedding")
    q = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.lit("").alias("owner"), F.col("embedding").alias("q_embedding"))
    return vector_top(q, e, 10, same_owner=False).select("query_id", "id", F.round("score", 6).alias("score"))


ALIAS = "alias AS (SELECT DISTINCT user_id, CAST(substr(user_id, 4) AS INT) % 10 AS grp FROM mem WHERE user_id <> ''), canon AS (SELECT a.user_id, min(b.user_id) AS canonical FROM alias a JOIN alias b USING (grp) GROUP BY 1)"


@query(_q(f"+{ALIAS} SELECT canonical, agent_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM mem JOIN canon USING (user_id) WHERE layer = 'l3_fact' AND dead = 0 GROUP BY 1, 2"))
def owner_groups(spark: SparkSession, d: str) -> DataFrame:
    """Facts by canonical owner and agent."""
    m = live(spark, d).filter("layer = 'l3_fact'")
    alias = X.table(spark, d, "documents").select(F.col("source").alias("user_id")).distinct().withColumn("grp", F.substring("user_id", 4, 9).cast("int") % 10)
    canon = alias.withColumn("canonical", F.min("user_id").over(Window.partitionBy("grp"))).select("user_id", "canonical")
    return m.join(canon, "user_id").groupBy("canonical", "agent_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_IDENT = "regexp_matches(regexp_replace(w, '^[.,;:!?\"''()\\[\\]{}]+|[.,;:!?\"''()\\[\\]{}]+$', '', 'g'), '[0-9_]|[\\p{L}\\p{Nd}][^\\p{L}\\p{Nd}\\s''’][\\p{L}\\p{Nd}]')"


@query(_q(f"+l AS (SELECT id, user_id, {T.tokens_sql('content')} AS toks, content FROM mem WHERE dead = 0), w AS (SELECT id AS query_id, user_id, list_filter(string_split(content, ' '), lambda w: {_IDENT})[1] AS word FROM l), q AS (SELECT query_id, user_id, {T.tokens_sql('word')} AS terms FROM w WHERE word IS NOT NULL) SELECT query_id, id FROM q JOIN l USING (user_id) WHERE len(terms) > 0 AND list_has_all(toks, terms)"))
def identifier_filter(spark: SparkSession, d: str) -> DataFrame:
    """A query that is an identifier (the first one of each row) is answered by the owner's rows that hold every term of it; found by the terms."""
    m = live(spark, d).select("id", "user_id", "content")
    q = m.select(F.col("id").alias("query_id"), "user_id", T.first_identifier(F.col("content")).alias("word")).filter("word is not null").select("query_id", "user_id", F.array_distinct(T.tokens("word")).alias("terms"))
    q = index.saved(q.select("query_id", "user_id", F.size("terms").alias("n"), F.explode("terms").alias("term")), "identifiers")
    # of a row's terms only those that its owner's queries ask for go on
    rows = m.select("id", F.col("user_id").alias("owner"), F.lower("content").alias("words")).mapInArrow(index.counting(T.term), "owner string, term string, id long, dl long, tf long").select(F.col("owner").alias("user_id"), "term", "id")
    rows = rows.join(q.select("user_id", "term").distinct(), ["user_id", "term"], "left_semi")
    return q.join(rows, ["user_id", "term"]).groupBy("query_id", "id").agg(F.count("*").alias("held"), F.first("n").alias("n")).filter("held = n").select("query_id", "id")


@query(_q(f"SELECT id FROM mem WHERE layer = 'l7_intention' AND dead = 0 AND date_diff('second', ts, TIMESTAMP '{X.NOW}') <= 29.5 * 86400"))
def open_intentions(spark: SparkSession, d: str) -> DataFrame:
    """intentions that aren't stale."""
    age = F.unix_timestamp(F.lit(X.NOW).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return live(spark, d).filter((F.col("layer") == "l7_intention") & (age <= 29.5 * 86400)).select("id")


@query(_q("SELECT id, ts FROM mem WHERE layer = 'l3_fact' AND dead = 0 AND ts < TIMESTAMP '2024-01-03' AND ts + INTERVAL 1 SECOND > TIMESTAMP '2024-01-02' ORDER BY ts DESC, id DESC LIMIT 500"))
def window_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Facts whose span overlaps a window, the newest 500."""
    w = (F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")) & (F.col("ts") + F.expr("interval 1 second") > F.lit("2024-01-02").cast("timestamp_ntz"))
    return live(spark, d).filter(F.col("layer") == "l3_fact").filter(w).select("id", "ts").orderBy(F.desc("ts"), F.desc("id")).limit(500)


@query(_q("SELECT id, ts FROM mem WHERE layer = 'l2_raw' AND dead = 0 AND id % 3 <> 0 ORDER BY ts, id LIMIT 20"))
def awaiting_extraction(spark: SparkSession, d: str) -> DataFrame:
    """The oldest raw rows that wait for extraction."""
    return live(spark, d).filter("layer = 'l2_raw' and id % 3 <> 0").select("id", "ts").orderBy("ts", "id").limit(20)


@query(_q("SELECT id, (SELECT count(*) FROM mem WHERE dead = 0 AND user_id = 'src3' AND layer <> 'l2_raw') AS total FROM mem WHERE dead = 0 AND user_id = 'src3' AND layer <> 'l2_raw' ORDER BY ts DESC, id DESC LIMIT 10 OFFSET 5"))
def list_page(spark: SparkSession, d: str) -> DataFrame:
    """K1: a page of rows and the total before paging."""
    rows = live(spark, d).filter("user_id = 'src3' and layer <> 'l2_raw'").select("id", "ts")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("ts"), F.desc("id")).offset(5).limit(10).crossJoin(F.broadcast(total)).select("id", "total")


@query(_q("SELECT layer, id FROM (SELECT layer, id, ts, row_number() OVER (PARTITION BY layer ORDER BY ts DESC, id DESC) AS n FROM mem WHERE dead = 0) WHERE n <= 12 AND ts >= TIMESTAMP '2024-01-03 12:00:00'"))
def recent_context(spark: SparkSession, d: str) -> DataFrame:
    """K5: the newest n of each layer, then the age limit."""
    n = F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("ts"), F.desc("id")))
    return live(spark, d).withColumn("n", n).filter("n <= 12").filter(F.col("ts") >= F.lit("2024-01-03 12:00:00").cast("timestamp_ntz")).select("layer", "id")


@query(_q("SELECT id, max(src) AS best FROM (SELECT id, 1 AS src FROM mem WHERE layer = 'l2_raw' AND id % 2 = 0 UNION ALL SELECT id, 2 FROM mem WHERE user_id IN ('src1', 'src4')) GROUP BY 1"))
def union_best(spark: SparkSession, d: str) -> DataFrame:
    """Lists of several owners or indexes, one row of each id."""
    m = X.mem(spark, d)
    a = m.filter("layer = 'l2_raw' and id % 2 = 0").select("id", F.lit(1).alias("src"))
    b = m.filter(F.col("user_id").isin("src1", "src4")).select("id", F.lit(2).alias("src"))
    return a.unionByName(b).groupBy("id").agg(F.max("src").alias("best"))


@query(_q("SELECT user_id, array_to_string(list(CAST(id AS VARCHAR) ORDER BY first_pos), ',') AS ids FROM (SELECT user_id, id, min(pos) AS first_pos FROM (SELECT user_id, id, id AS pos FROM mem UNION ALL SELECT user_id, id, id + 1000000000 FROM mem WHERE id % 7 = 0) GROUP BY 1, 2) GROUP BY 1"))
def unique_append(spark: SparkSession, d: str) -> DataFrame:
    """Ids appended in order, each once at its first place."""
    m = X.mem(spark, d).select("user_id", "id")
    both = m.withColumn("pos", F.col("id")).unionByName(m.filter("id % 7 = 0").withColumn("pos", F.col("id") + 1000000000))
    first = both.groupBy("user_id", "id").agg(F.min("pos").alias("p"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col("id").cast("string").alias("id")))), lambda x: x["id"]), ",").alias("ids"))


@query("SELECT event_type AS origin, count(*) AS n, count(*) FILTER (event_type NOT IN ('view', 'error')) AS extract_wanted, count(*) FILTER (event_type = 'click') AS forgettable FROM events GROUP BY 1")
def ingest_policy(spark: SparkSession, d: str) -> DataFrame:
    """What ingestion marks rows with, by their origin."""
    from recallgrid.sources.ingest import with_policy

    e = with_policy(X.table(spark, d, "events").withColumn("origin", F.col("event_type")), {"click": (True, True), "view": (False, False), "error": (False, False)})
    return e.groupBy("origin").agg(F.count("*").alias("n"), F.sum(F.col("extract_wanted").cast("long")).alias("extract_wanted"), F.sum(F.col("forgettable").cast("long")).alias("forgettable"))


@query(_q(f"SELECT a.id AS a, b.id AS b FROM mem a JOIN mem b ON a.user_id = b.user_id AND a.id < b.id AND lower(trim(a.content)) = lower(trim(b.content)) AND a.layer = b.layer"))
def mirrors(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one owner and layer with the same text, as pairs of the first with each later one and among them."""
    m = X.mem(spark, d).select("id", "user_id", "layer", F.lower(F.trim("content")).alias("k"))
    a, b = m.withColumnRenamed("id", "a"), m.withColumnRenamed("id", "b")
    return a.join(b, ["user_id", "layer", "k"]).filter("a < b").select("a", "b")
