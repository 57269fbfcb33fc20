"""The owner-scoped graph with two time axes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.operators import graph as G
from recallgrid.operators.cluster import FEW_VECTORS, Named, held
from recallgrid.registry import query
from recallgrid.sources.index import shared_folder


def _q(sql: str) -> str:
    return X.with_views("edges", sql=sql)


_NEW = "SELECT l_linestatus AS owner, concat('s', l_suppkey) AS src, concat('p', l_partkey) AS dst, l_returnflag AS relation, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS dy, l_orderkey AS source FROM lineitem"


@query(f"SELECT owner, src, relation, dst, min(dy) AS recorded_at, len(list_distinct(list(source))) AS n_sources FROM ({_NEW}) GROUP BY 1, 2, 3, 4")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Half of the lines are the graph, the others are added; one edge of each owner's key, the first recording stays, sources are joined."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    e = X.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("owner"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("relation"), day.alias("recorded_at"), day.alias("valid_from"), day.alias("valid_to"), F.array("l_orderkey").alias("sources"), "l_linenumber")
    old, new = (e.filter(f"l_linenumber % 2 = {k}").drop("l_linenumber") for k in (0, 1))
    return G.upsert(old, new).select("owner", "src", "relation", "dst", "recorded_at", F.size("sources").cast("long").alias("n_sources"))


@query(_q("SELECT src, relation, dst, list_sort(list_distinct(list_filter(list_concat([CASE WHEN n % 2 = 0 THEN 0 ELSE sources[1] END], CASE WHEN n % 2 = 0 THEN sources ELSE [] END), lambda s: s <> 0)))[1] AS first_source FROM edges WHERE owner = 'O' OR owner = ''"))
def graph_load(spark: SparkSession, d: str) -> DataFrame:
    """A stored graph read back; old edges with one source get a list of it; edges of an owner and of nobody."""
    e = X.edges(spark, d).withColumn("source", F.when(F.col("n") % 2 == 0, F.lit(0)).otherwise(F.get("sources", F.lit(0)))).withColumn("sources", F.when(F.col("n") % 2 == 0, F.col("sources")).otherwise(F.array().cast("array<bigint>")))
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    G.normalised(e).write.parquet(path)
    return G.visible(spark.read.parquet(path), "O").select("src", "relation", "dst", F.array_min("sources").alias("first_source"))


@query(_q("SELECT DISTINCT other FROM (SELECT dst AS other FROM edges WHERE src = 's1' UNION ALL SELECT src FROM edges WHERE dst = 's1')"))
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Both directions."""
    return G.neighbours(X.edges(spark, d), "s1")


AT = 10500


@query(_q(f"SELECT src, relation, dst FROM edges WHERE recorded_at <= {AT} AND (invalidated_at = 0 OR invalidated_at > {AT}) AND valid_from <= {AT} AND (valid_to = 0 OR valid_to > {AT})"))
def graph_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Half-open on both axes, 0 for unset."""
    return G.as_of(X.edges(spark, d), AT, AT).select("src", "relation", "dst")


@query(_q("+k AS (SELECT DISTINCT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) ORDER BY id LIMIT 2050) SELECT src, relation, dst FROM edges WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)"))
def graph_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The first nodes by label, and the edges between them."""
    e = X.edges(spark, d)
    return G.between(e, G.nodes(e).orderBy("id").limit(2050)).select("src", "relation", "dst")


@query(_q("SELECT (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes, count(*) AS edges, count(*) FILTER (owner IN ('O', '')) AS scoped FROM edges"))
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    """A3, F10."""
    e = X.edges(spark, d)
    n = G.nodes(e).agg(F.count("*").alias("nodes"))
    return e.agg(F.count("*").alias("edges"), F.count(F.when(F.col("owner").isin("O", ""), 1)).alias("scoped")).crossJoin(n).select("nodes", "edges", "scoped")


@query(_q("+x AS (SELECT src, relation, dst, sources, list_filter(sources, lambda s: s % 3 <> 0) AS kept FROM edges) SELECT src, relation, dst, len(kept) AS kept FROM x WHERE len(kept) > 0 OR len(sources) = 0"))
def remove_sources(spark: SparkSession, d: str) -> DataFrame:
    """M5: an edge goes with its last source."""
    gone = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("s")).filter("s % 3 = 0")
    return G.remove_sources(X.edges(spark, d), gone).select("src", "relation", "dst", F.size("sources").cast("long").alias("kept"))


@query(_q("SELECT concat('l5-', substr(sha256(concat_ws(chr(31), lower(src), lower(relation), lower(dst))), 1, 16)) AS id, concat_ws(' ', src, replace(relation, '_', ' '), dst) AS content FROM edges WHERE valid_to > 10600"))
def edge_documents(spark: SparkSession, d: str) -> DataFrame:
    """A text row for every edge."""
    return G.documents(X.edges(spark, d).filter("valid_to > 10600"))


@query(X.with_views("mem", sql="+s AS (SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS n, count(*) OVER (PARTITION BY session_id) AS c FROM (SELECT * FROM mem WHERE dead = 0 AND layer NOT IN ('l1_profile', 'l8_entity') QUALIFY row_number() OVER (PARTITION BY layer ORDER BY ts DESC, id DESC) <= 200)) SELECT a.session_id, a.id AS src, b.id AS dst FROM s a JOIN s b ON a.session_id = b.session_id AND a.n = 1 AND b.n BETWEEN 2 AND 6 WHERE a.c BETWEEN 2 AND 20"))
def session_edges(spark: SparkSession, d: str) -> DataFrame:
    """A star from the first row of each session, at most five edges, among the 200 newest rows of each layer (each task sends no more than these)."""
    m = X.mem(spark, d).filter("dead = 0").filter(~F.col("layer").isin("l1_profile", "l8_entity"))
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("ts"), F.desc("id")))).filter("r <= 200").drop("r")
    w = Window.partitionBy("session_id")
    s = m.withColumn("n", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("id")))).withColumn("c", F.count("*").over(w))
    s = s.withColumn("src", F.first("id").over(w.orderBy(F.desc("ts"), F.desc("id"))))
    return s.filter("c between 2 and 20 and n between 2 and 6").select("session_id", "src", F.col("id").alias("dst"))


@query(X.with_views("mem", sql="+n AS (SELECT * FROM mem WHERE layer = 'l3_fact' AND dead = 0), q AS (SELECT * FROM n ORDER BY ts DESC, id DESC LIMIT 20) SELECT src, dst, k FROM (SELECT q.id AS src, n.id AS dst, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[]), 9) DESC, n.id) AS k FROM q JOIN n ON q.id <> n.id) WHERE k <= 3"))
def semantic_edges(spark: SparkSession, d: str) -> DataFrame:
    """The nearest facts of the twenty newest."""
    from recallgrid.operators.rank import vector_top

    n = X.mem(spark, d, True).filter("layer = 'l3_fact' and dead = 0")
    q = n.orderBy(F.desc("ts"), F.desc("id")).limit(20).select(F.col("id").alias("query_id"), F.lit("").alias("owner"), F.col("embedding").alias("q_embedding"))
    top = vector_top(q, n, 4, same_owner=False).filter("query_id <> id")
    k = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return top.withColumn("k", k).filter("k <= 3").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "k")


_DIGITS = "list_sort(list_distinct(regexp_extract_all({}, '([0-9]+)', 1)))"
_SCORE = "round(array_cosine_similarity(x.embedding, y.embedding), 6)"
_RESTATED = f"""+k AS (SELECT *, CAST(substr(src, 2) AS BIGINT) AS s, CAST(substr(dst, 2) AS BIGINT) AS p, strpos('ANR', relation) - 1 AS c FROM edges),
ed AS MATERIALIZED (SELECT (s * 10000000 + p) * 3 + c AS id, src AS user_id, p, concat(dst, CASE WHEN relation = 'R' THEN concat(' v', CAST(n % 3 + 1 AS VARCHAR)) ELSE '' END, ' ', relation, ' ', src) AS txt, recorded_at >= 9500 AS fresh,
 list_transform(range(1, len(t.embedding) + 1), lambda i: CAST(t.embedding[i] AS DOUBLE) + {list(X.APART)}[(p + c) % 3 + 1]::DOUBLE * CAST(o.embedding[i] AS DOUBLE))::DOUBLE[64] AS embedding FROM k JOIN embeddings t ON t.vec_id = p % 40 JOIN embeddings o ON o.vec_id = (s * 31 + p * 7 + c) % (SELECT count(*) FROM embeddings)),
nm AS (SELECT id, p, {_DIGITS.format("txt")} AS nums, {_DIGITS.format("regexp_replace(txt, ' v[0-9]+', '')")} AS bare FROM ed),
pr AS MATERIALIZED (SELECT x.id AS x, y.id AS y, {_SCORE} AS score FROM ed x JOIN ed y ON x.user_id = y.user_id AND x.fresh AND x.id <> y.id AND (NOT y.fresh OR y.id < x.id) WHERE {_SCORE} >= {G.SAME_ENDS}),
cd AS (SELECT r.x, r.y, r.score, (r.score >= {G.SAME} AND a.nums = b.nums) OR (a.bare = b.bare AND a.p = b.p) AS ok FROM pr r JOIN nm a ON a.id = r.x JOIN nm b ON b.id = r.y),
nn AS MATERIALIZED (SELECT x, list({{'y': y, 'ok': ok}} ORDER BY score DESC, y) AS near FROM cd GROUP BY 1),
pl AS MATERIALIZED (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY id) - 1 AS o, count(*) OVER (PARTITION BY user_id) AS m FROM ed JOIN nn ON nn.x = ed.id),
wk AS (SELECT user_id, m, 0::BIGINT AS i, []::BIGINT[] AS gone, 0::BIGINT AS x, CAST(NULL AS BIGINT) AS y FROM (SELECT DISTINCT user_id, m FROM pl)
 UNION ALL SELECT user_id, m, i + 1, CASE WHEN t.ok THEN list_append(gone, nx) ELSE gone END, nx, CASE WHEN t.ok THEN t.y END FROM (SELECT w.user_id, w.m, w.i, w.gone, q.id AS nx, list_filter(coalesce(c.near, []), lambda z: NOT list_contains(w.gone, z.y))[1] AS t FROM wk w JOIN pl q ON q.user_id = w.user_id AND q.o = w.i LEFT JOIN nn c ON c.x = q.id WHERE w.i < w.m))
SELECT x AS id, y AS "by" FROM wk WHERE y IS NOT NULL"""


@query(_q(_RESTATED).replace("WITH ", "WITH RECURSIVE ", 1))
def restated_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges recorded from some day on are new; those that restate what their supplier's nearest indexed edge says, with dealt vectors of a topic for each group of parts."""
    s, p, c = F.substring("src", 2, 20).cast("long"), F.substring("dst", 2, 20).cast("long"), F.instr(F.lit("ANR"), F.col("relation")) - 1
    e = X.edges(spark, d, dealt=True).select("src", "dst", "relation", "n", "recorded_at", s.alias("s"), p.alias("p"), c.cast("long").alias("c"))
    v = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    heads = {r["v"]: r["embedding"] for r in v.filter("v < 40").collect()}
    w = F.get(F.array(*map(F.lit, X.APART)), ((F.col("p") + F.col("c")) % 3).cast("int"))
    many = v.count()
    docs = e.select(
        ((F.col("s") * 10000000 + F.col("p")) * 3 + F.col("c")).alias("id"), F.col("src").alias("user_id"), F.lit("").alias("agent_id"), F.concat("dst", F.when(F.col("relation") == "R", F.concat(F.lit(" v"), (F.col("n") % 3 + 1).cast("string"))).otherwise("")).alias("src"),
        "relation", F.col("src").alias("dst"), F.pmod(F.col("s") * 31 + F.col("p") * 7 + F.col("c"), F.lit(max(1, many))).alias("v"), (F.col("p") % 40).alias("t"), w.alias("w"), (F.col("recorded_at") >= 9500).alias("fresh"),
    ).filter(F.col("t").isin(*heads))
    named = Named(v, heads)
    return G.restatements(docs, named=named) if many <= FEW_VECTORS else G.restatements(held(docs, named))
