"""The write side: what an extraction, a reconciliation, a consolidation or a plan of edits changes.

What a model would reply comes in as rows of a table (here made from the driver's tables); every query
decodes, validates and applies it, and returns what changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.functions import text as T
from recallgrid.functions.vector import cosine
from recallgrid.operators import lifecycle as L
from recallgrid.operators.nearest import nearest as nearest_rows
from recallgrid.registry import query
from recallgrid.sources import ingest
from recallgrid.sources.index import saved, shared_folder

RESTATED, RELATED, MERGED = 0.92, 0.70, 0.65
NUMS = "list_sort(list_distinct(regexp_extract_all({t}, '([0-9]+)', 1)))"
FACTS = "facts AS (SELECT * FROM mem WHERE layer = 'l3_fact' AND dead = 0)"
COS = "list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _q(sql: str) -> str:
    return X.with_views("mem", sql=sql)


def facts(spark: SparkSession, d: str) -> DataFrame:
    return X.mem(spark, d, True).filter("layer = 'l3_fact' and dead = 0")


@query(_q("SELECT layer, count(*) AS n, true AS complete FROM mem GROUP BY 1"))
def open_store(spark: SparkSession, d: str) -> DataFrame:
    """Rows written by layer with an index of counts; opened, each layer's count is held against the index."""
    path = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    rows = X.mem(spark, d).select("id", "layer", "content", "user_id", "agent_id", "ts")
    ingest.write_rows(rows, f"{path}/rows")
    rows.groupBy("layer").agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")
    return ingest.checked(ingest.open_rows(spark, f"{path}/rows"), spark.read.parquet(f"{path}/counts"))


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN event_type ELSE props END AS content, CASE WHEN event_type = 'click' THEN 'memory_tool' WHEN event_type = 'error' THEN 'doctor' ELSE 'agent' END AS origin, event_type <> 'error' AS extract_wanted FROM events WHERE event_id % 7 <> 0")
def ingest_rows(spark: SparkSession, d: str) -> DataFrame:
    """Text or data is needed; rows get owner, layer and what their origin allows."""
    origin = F.when(F.col("event_type") == "click", "memory_tool").when(F.col("event_type") == "error", "doctor").otherwise("agent")
    e = X.table(spark, d, "events").select(F.col("event_id").alias("id"), F.when((F.col("event_id") % 5 == 0) & (F.col("event_id") % 7 != 0), F.col("event_type")).otherwise("  ").alias("text"), F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("data"), origin.alias("origin"), F.col("user_id").cast("string").alias("user_id"), "ts")
    return ingest.accepted(e).select("id", "content", "origin", "extract_wanted")


@query(_q("SELECT id, CASE WHEN layer = 'l4_summary' AND dead = 0 AND id % 2 = 0 THEN upper(left(content, 40)) ELSE content END AS content, layer = 'l4_summary' AND dead = 0 AND id % 2 = 0 AS embed_again FROM mem"))
def rewrite_layer(spark: SparkSession, d: str) -> DataFrame:
    """Live rows of one layer get a new content and are marked to be embedded again; id and the rest stay."""
    m = X.mem(spark, d)
    new = m.filter("id % 2 = 0").select("id", T.upper(F.substring("content", 1, 40)).alias("new"))
    return ingest.rewrite(m, new, "l4_summary").select("id", "content", "embed_again")


_GONE = "gone AS (SELECT id FROM mem WHERE user_id = 'src3' AND agent_id = 'en')"


@query(X.with_views("mem", "retired", sql=", ").replace("WITH ", "WITH RECURSIVE ").rstrip(" ,") + f", {_GONE}, c AS (SELECT id, superseded_by AS last, 1 AS n FROM retired UNION ALL SELECT c.id, r.superseded_by, n + 1 FROM c JOIN retired r ON r.id = c.last WHERE c.last IN (SELECT id FROM gone) AND n < 10000), e AS (SELECT id, last FROM c WHERE last NOT IN (SELECT id FROM gone)) SELECT r.id, e.last AS superseded_by, CASE WHEN e.last IS NULL THEN 'dropped' ELSE 'replaced' END AS how FROM retired r LEFT JOIN e USING (id) WHERE r.id NOT IN (SELECT id FROM gone)")
def delete_scope(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an owner and agent go; who was replaced by one of them follows the chain to a row that stays, or counts as dropped."""
    m, r = X.mem(spark, d), X.retired(spark, d)
    gone = m.filter("user_id = 'src3' and agent_id = 'en'").select("id")
    return L.relink(r, gone).select("id", "superseded_by", "how")


NEAR = f"""{FACTS}, neu AS (SELECT f.*, v.embedding AS nv FROM facts f JOIN embeddings v ON v.vec_id = (f.id * 3 + 1) % (SELECT count(*) FROM embeddings) WHERE f.id % 20 = 0),
near AS (SELECT * FROM (SELECT n.id AS fact, n.content AS text, o.id, o.content, o.label, round({COS.format(a='n.nv', b='o.embedding')}, 9) AS score, row_number() OVER (PARTITION BY n.id ORDER BY round({COS.format(a='n.nv', b='o.embedding')}, 9) DESC, o.id) AS k FROM neu n JOIN facts o ON o.user_id = n.user_id AND o.id <> n.id))"""


def nearest(spark: SparkSession, d: str, k: int, shown: str = "true") -> DataFrame:
    """fact, id, score, k: the first k facts of the owner for which shown holds, by their nearness to a new text (here that of every fact with an id divisible by 20, with another vector)."""
    f = facts(spark, d)
    new = X.with_vectors(f.filter("id % 20 = 0").select("id", "user_id"), spark, d, F.col("id") * 3 + 1)
    return nearest_rows(new, f.filter(shown).select("id", "user_id", "embedding"), k, ("user_id",)).select(F.col("x").alias("fact"), F.col("y").alias("id"), "score", "k")


def same_numbers(pairs: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """pairs (fact, id) whose texts have the same numbers."""
    nums = X.mem(spark, d).filter("layer = 'l3_fact' and dead = 0").select("id", T.digit_runs(F.col("content")).alias("nums"))
    both = pairs.join(nums, "id").join(nums.select(F.col("id").alias("fact"), F.col("nums").alias("mine")), "fact")
    return both.filter(F.col("nums") == F.col("mine")).drop("nums", "mine")


#: Synthetic vectors are seldom as near as real ones; the thresholds here let the rules act.
LOW = 0.05


@query(_q(f"""+{NEAR}, shown AS (SELECT fact, id, k FROM near WHERE k <= 6 AND score >= {LOW / 2}),
st AS (SELECT fact, id, 3 AS o, 'restated' AS how FROM near WHERE k = 1 AND score >= {LOW} AND {NUMS.format(t='content')} = {NUMS.format(t='text')}
 UNION ALL SELECT fact, id, 1, 'replaced' FROM shown WHERE k IN (2, 3) UNION ALL SELECT fact, id, 2, 'updated' FROM shown WHERE k IN (3, 4))
SELECT id, fact AS superseded_by, how FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fact, o) AS n FROM st) WHERE n = 1"""))
def promote_facts(spark: SparkSession, d: str) -> DataFrame:
    """A new fact retires its nearest restatement with the same numbers, and the shown facts that it replaces or updates (replacing wins)."""
    n = saved(nearest(spark, d, 6), "nearest")
    shown = n.filter(F.col("score") >= LOW / 2).select("fact", "id", "k")
    restated = same_numbers(n.filter((F.col("k") == 1) & (F.col("score") >= LOW)), spark, d).select("fact", "id", F.lit(3).alias("o"), F.lit("restated").alias("how"))
    replaced = shown.filter("k in (2, 3)").select("fact", "id", F.lit(1).alias("o"), F.lit("replaced").alias("how"))
    updated = shown.filter("k in (3, 4)").select("fact", "id", F.lit(2).alias("o"), F.lit("updated").alias("how"))
    every = restated.unionByName(replaced).unionByName(updated)
    first = F.row_number().over(Window.partitionBy("id").orderBy("fact", "o"))
    return every.withColumn("n", first).filter("n = 1").select("id", F.col("fact").alias("superseded_by"), "how")


@query(_q(f"+{NEAR} SELECT fact, arg_min(id, k) AS id FROM (SELECT *, row_number() OVER (PARTITION BY fact ORDER BY k) AS kk FROM near WHERE label = 'experience') WHERE kk <= 10 AND score >= {LOW} AND {NUMS.format(t='content')} = {NUMS.format(t='text')} GROUP BY 1"))
def write_experiences(spark: SparkSession, d: str) -> DataFrame:
    """M9: of the ten nearest experiences, the nearest that is the same lesson, with the same numbers, is updated."""
    n = same_numbers(nearest(spark, d, 10, "label = 'experience'").filter(F.col("score") >= LOW), spark, d)
    return n.groupBy("fact").agg(F.min_by("id", "k").alias("id"))


@query(_q(f"+{NEAR} SELECT fact, id, row_number() OVER (PARTITION BY fact ORDER BY k) AS n FROM near WHERE label <> 'experience' AND score >= {LOW / 2} QUALIFY n <= 8"))
def reconcile_candidates(spark: SparkSession, d: str) -> DataFrame:
    """M10's candidates: the nearest facts of the owner above a threshold, no experiences, eight at most."""
    return nearest(spark, d, 8, "label <> 'experience'").filter(F.col("score") >= LOW / 2).select("fact", "id", F.col("k").alias("n"))


MERGE = f"""{FACTS}, grp AS (SELECT user_id, agent_id, floor(id / 160) AS g, f.*, (id * 11 + 3) % 5 = 0 AS invented FROM facts f),
txt AS (SELECT user_id, agent_id, g, min(id) AS head FROM grp GROUP BY 1, 2, 3),
mem2 AS (SELECT t.head, x.id, x.label, x.embedding, h.embedding AS tv FROM txt t JOIN grp x ON x.user_id = t.user_id AND x.agent_id = t.agent_id AND x.g = t.g JOIN facts h ON h.id = t.head WHERE NOT x.invented),
ont AS (SELECT * FROM mem2 WHERE {COS.format(a='tv', b='embedding')} >= {LOW / 2}),
ok AS (SELECT head, count(*) AS n, count(*) FILTER (label = 'experience') AS e FROM ont GROUP BY 1 HAVING count(*) >= 2 AND (count(*) FILTER (label = 'experience') = 0 OR count(*) FILTER (label = 'experience') = count(*)))"""


@query(_q(f"+{MERGE} SELECT o.id, o.head AS merged, CASE WHEN k.e > 0 THEN 'experience' ELSE 'consolidated' END AS label FROM ont o JOIN ok k USING (head)"))
def apply_merges(spark: SparkSession, d: str) -> DataFrame:
    """Facts that a merged text is about (near enough to it) are absorbed, two at least; experiences only merge with experiences; ids that weren't shown change nothing."""
    f = facts(spark, d).withColumn("g", F.floor(F.col("id") / 160))
    texts = f.groupBy("user_id", "agent_id", "g").agg(F.min("id").alias("head")).join(f.select(F.col("id").alias("head"), F.col("embedding").alias("tv")), "head")
    shown = f.filter("(id * 11 + 3) % 5 <> 0").select("user_id", "agent_id", "g", "id", "label", "embedding")
    on = texts.join(shown, ["user_id", "agent_id", "g"]).filter(cosine(F.col("tv"), F.col("embedding")) >= LOW / 2).select("head", "id", "label")
    w = Window.partitionBy("head")
    on = on.withColumn("n", F.count("*").over(w)).withColumn("e", F.count(F.when(F.col("label") == "experience", 1)).over(w))
    return on.filter("n >= 2 and (e = 0 or e = n)").select("id", F.col("head").alias("merged"), F.when(F.col("e") > 0, "experience").otherwise("consolidated").alias("label"))


@query(_q("SELECT id, reason FROM (SELECT id, trim(CASE WHEN id % 3 = 0 THEN '  ' ELSE concat(' stale ', CAST(id AS VARCHAR)) END) AS reason FROM mem WHERE layer = 'l3_fact' AND dead = 0 AND id % 2 = 0) WHERE reason <> ''"))
def apply_drops(spark: SparkSession, d: str) -> DataFrame:
    """M11's drops: only shown live facts, and only with a reason."""
    asked = spark.range(0, X.table(spark, d, "documents").count(), 2).select("id", F.trim(F.when(F.col("id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" stale "), F.col("id").cast("string")))).alias("reason"))
    return asked.join(X.mem(spark, d).filter("layer = 'l3_fact' and dead = 0").select("id"), "id").filter("reason <> ''").select("id", "reason")


@query(_q("SELECT src, relation, dst, count(DISTINCT turn) AS turns FROM (SELECT agent_id AS src, label AS relation, user_id AS dst, unnest(CASE WHEN id % 4 = 0 THEN [id] ELSE [id // 100, id // 50] END) AS turn FROM mem WHERE layer = 'l3_fact' AND dead = 0 AND label <> '') GROUP BY 1, 2, 3 HAVING count(DISTINCT turn) >= 2"))
def corroborated_edges(spark: SparkSession, d: str) -> DataFrame:
    """A12, M11's edges: a relation is written if two different turns stand behind its evidence; a fact without a source is its own turn."""
    turn = F.when(F.col("id") % 4 == 0, F.array("id")).otherwise(F.array(F.floor(F.col("id") / 100), F.floor(F.col("id") / 50)))
    f = X.mem(spark, d).filter("layer = 'l3_fact' and dead = 0 and label <> ''").select(F.col("agent_id").alias("src"), F.col("label").alias("relation"), F.col("user_id").alias("dst"), F.explode(turn).alias("turn"))
    return f.groupBy("src", "relation", "dst").agg(F.countDistinct("turn").alias("turns")).filter("turns >= 2")


_NORM = "trim(regexp_replace(lower(content), '\\s+', ' ', 'g'), ' .,;:!?\"''()[]{}')"


@query(_q(f"SELECT id FROM (SELECT id, user_id, agent_id, row_number() OVER (PARTITION BY user_id, agent_id, {_NORM} ORDER BY id) AS n, {_NORM} AS k FROM mem WHERE layer = 'l6_schema' AND dead = 0 AND id % 2 = 1) s WHERE n = 1 AND k <> '' AND NOT EXISTS (SELECT 1 FROM (SELECT user_id, agent_id, {_NORM} AS k FROM mem WHERE layer = 'l6_schema' AND dead = 0 AND id % 2 = 0) o WHERE o.user_id = s.user_id AND o.agent_id = s.agent_id AND o.k = s.k)"))
def new_schemas(spark: SparkSession, d: str) -> DataFrame:
    """M11's schemas, X12: a pattern whose normalised text the owner has already isn't written again (odd ids are new, even ones stored)."""
    s = X.mem(spark, d).filter("layer = 'l6_schema' and dead = 0").withColumn("k", T.normalised("content"))
    by = ["user_id", "agent_id", "k"]
    new = s.filter("id % 2 = 1 and k <> ''").join(s.filter("id % 2 = 0").select(*by), by, "left_anti")
    return new.groupBy(*by).agg(F.min("id").alias("id")).select("id")


CROSS = "sch AS (SELECT *, row_number() OVER (PARTITION BY user_id, agent_id ORDER BY ts DESC, id DESC) AS n, count(*) OVER (PARTITION BY user_id, agent_id) AS c FROM mem WHERE layer = 'l6_schema' AND dead = 0 AND id % 9 <> 0), sh AS (SELECT *, floor(id / 160) % 3 AS topic FROM sch WHERE c >= 2 AND n <= 40)"


@query(_q(f"+{CROSS} SELECT user_id, agent_id, count(*) AS shown, count(DISTINCT topic) AS topics FROM sh GROUP BY 1, 2 HAVING count(DISTINCT topic) >= 2"))
def cross_topic(spark: SparkSession, d: str) -> DataFrame:
    """Owners with enough schemas (two here) of two topics at least; the newest forty are shown, those of the pass itself not."""
    w = Window.partitionBy("user_id", "agent_id")
    s = X.mem(spark, d).filter("layer = 'l6_schema' and dead = 0 and id % 9 <> 0").withColumn("n", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("id")))).withColumn("c", F.count("*").over(w))
    s = s.filter("c >= 2 and n <= 40").withColumn("topic", F.floor(F.col("id") / 160) % 3)
    return s.groupBy("user_id", "agent_id").agg(F.count("*").alias("shown"), F.countDistinct("topic").alias("topics")).filter("topics >= 2")


PLAN = "plan AS (SELECT id, newer FROM (SELECT f.id, n.id AS newer, row_number() OVER (PARTITION BY f.id ORDER BY n.id) AS k FROM (SELECT * FROM mem WHERE layer = 'l3_fact' AND dead = 0) f JOIN (SELECT * FROM mem WHERE layer = 'l3_fact' AND dead = 0) n ON n.user_id = f.user_id AND n.id <> f.id AND n.id BETWEEN f.id - 400 AND f.id + 400 AND n.ts::DATE >= f.ts::DATE AND f.id % 3 <> 0) WHERE k = 1)"


@query(_q(f"+{PLAN} SELECT id, newer FROM plan"))
def backlog_plan(spark: SparkSession, d: str) -> DataFrame:
    """M13's plan: pairs of one owner's live facts, the newer not dated before the older, the first of each id."""
    f = X.mem(spark, d).filter("layer = 'l3_fact' and dead = 0").select("id", "user_id", F.col("ts").cast("date").alias("day"))
    p = f.join(f.select(F.col("id").alias("by"), "user_id", F.col("day").alias("by_day")), "user_id").filter("by <> id and by between id - 400 and id + 400 and by_day >= day and id % 3 <> 0")
    return p.groupBy("id").agg(F.min("by").alias("newer"))


@query()
def backlog_apply(spark: SparkSession, d: str) -> DataFrame:
    """The plan applied in order of id; a step that would close a loop of replacements is left out."""
    p = backlog_plan(spark, d).withColumnRenamed("newer", "by").join(X.mem(spark, d).select("id", "user_id"), "id")
    return L.without_cycles(p)


@query(_q("SELECT r.id FROM mem r WHERE r.layer = 'l2_raw' AND r.origin = 'click' AND r.user_id IN ('src1', 'src11') AND r.agent_id = 'en' AND trim(r.content) = trim((SELECT content FROM mem WHERE layer = 'l2_raw' AND origin = 'click' AND user_id IN ('src1', 'src11') AND agent_id = 'en' ORDER BY id LIMIT 1))"))
def forget_target(spark: SparkSession, d: str) -> DataFrame:
    """M4: the raw rows that a forget names: of a forgettable origin, the owner's group, the agent and the exact trimmed text."""
    r = X.mem(spark, d).filter("layer = 'l2_raw' and origin = 'click' and user_id in ('src1', 'src11') and agent_id = 'en'").select("id", F.trim("content").alias("t"))
    one = r.orderBy("id").limit(1).select(F.col("t").alias("wanted"))
    return r.join(F.broadcast(one), F.col("t") == F.col("wanted")).select("id")


# --- entity pages ------------------------------------------------------------------------------

#: Updates of pages: entity (any spelling), attribute, value, when, source.
UPDATES = "upd AS (SELECT event_id AS source, concat('Item ', CAST(user_id AS VARCHAR)) AS page, CASE event_id % 3 WHEN 0 THEN concat('item ', CAST(user_id AS VARCHAR)) WHEN 1 THEN concat('ITEM ', CAST(user_id AS VARCHAR), '.') ELSE concat('Item ', CAST(user_id AS VARCHAR), ' v2.1') END AS spelling, event_type AS attr, CAST(floor(value / 20) AS BIGINT) AS val, ts FROM events)"


def page_updates(spark: SparkSession, d: str) -> DataFrame:
    """source, page, attr, val, ts: updates whose spelling is matched to a page by its normalised name."""
    e = X.table(spark, d, "events")
    u = F.col("user_id").cast("string")
    spelling = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("item "), u)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("ITEM "), u, F.lit("."))).otherwise(F.concat(F.lit("Item "), u, F.lit(" v2.1")))
    name = F.array_join(T.name_tokens(spelling), " ")
    return e.select(F.col("event_id").alias("source"), name.alias("page"), F.col("event_type").alias("attr"), F.floor(F.col("value") / 20).cast("long").alias("val"), "ts", spelling.alias("spelling"))


@query(f"WITH {UPDATES}, c AS (SELECT *, lag(val) OVER (PARTITION BY page, attr ORDER BY ts, source) AS old FROM upd) SELECT lower(page) AS page, attr, source, old, val FROM c WHERE old IS NOT NULL AND old <> val")
def page_history(spark: SparkSession, d: str) -> DataFrame:
    """Pages are found by normalised name; a changed attribute moves its old value to the history, the same value changes nothing."""
    w = Window.partitionBy("page", "attr").orderBy("ts", "source")
    return page_updates(spark, d).withColumn("old", F.lag("val").over(w)).filter("old is not null and old <> val").select("page", "attr", "source", "old", "val")


@query(f"WITH {UPDATES} SELECT lower(page) AS page, count(DISTINCT lower(spelling)) FILTER (lower(spelling) <> lower(page)) AS aliases FROM upd GROUP BY 1")
def page_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Other spellings of a page's name are its aliases (case apart), eight at most."""
    u = page_updates(spark, d).withColumn("s", F.lower("spelling"))
    return u.groupBy("page").agg(F.least(F.countDistinct(F.when(F.col("s") != F.col("page"), F.col("s"))), F.lit(8)).alias("aliases"))


PAGE_STATE = f"{UPDATES}, c AS (SELECT *, lag(val) OVER (PARTITION BY page, attr ORDER BY ts, source) AS old FROM upd), st AS (SELECT lower(page) AS page, attr, arg_max(val, (ts, source)) AS val, arg_max(ts, (ts, source)) AS since, arg_max(source, (ts, source)) AS source FROM c WHERE old IS NULL OR old <> val GROUP BY 1, 2)"


def page_state(spark: SparkSession, d: str) -> DataFrame:
    """page, attr, val, since, source: the value of each attribute since its last change, the twelve latest of a page."""
    w = Window.partitionBy("page", "attr").orderBy("ts", "source")
    c = page_updates(spark, d).withColumn("old", F.lag("val").over(w)).filter("old is null or old <> val")
    s = c.groupBy("page", "attr").agg(F.max(F.struct("ts", "source", "val")).alias("x")).select("page", "attr", "x.val", F.col("x.ts").alias("since"), "x.source")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("since"), F.desc("source")))).filter("n <= 12").drop("n")


@query(f"WITH {PAGE_STATE} SELECT page, attr, val FROM st WHERE source % 10 <> 3")
def page_forget(spark: SparkSession, d: str) -> DataFrame:
    """M6: what a page knows from forgotten sources (ids that end in 3) goes; a page without any entry is gone."""
    s = page_state(spark, d)
    gone = s.filter("source % 10 = 3").select("source").distinct()
    return s.join(gone, "source", "left_anti").select("page", "attr", "val")


@query(f"WITH {PAGE_STATE} SELECT page, concat('pageid-', substr(sha1(concat(page, chr(10), string_agg(concat(attr, ': ', CAST(val AS VARCHAR)), chr(10) ORDER BY attr))), 1, 12)) AS doc_id FROM st GROUP BY 1")
def page_reindex(spark: SparkSession, d: str) -> DataFrame:
    """One document of each page, named by the hash of its text; a changed text gives another id, whose predecessor is superseded."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attr", F.col("val").cast("string").alias("val")))), lambda x: F.concat(x["attr"], F.lit(": "), x["val"])), "\n")
    t = page_state(spark, d).groupBy("page").agg(lines.alias("body"))
    return t.select("page", F.concat(F.lit("pageid-"), F.substring(F.sha1(F.concat("page", F.lit("\n"), "body")), 1, 12)).alias("doc_id"))


# --- rules on pairs and rows ---------------------------------------------------------------------


@query("WITH e AS (SELECT p_partkey AS id, p_name AS a, lag(p_name) OVER (ORDER BY p_partkey) AS b, concat(p_name, ' v', CAST(p_partkey % 5 AS VARCHAR), '.0') AS c FROM part) SELECT id, a = b AS same_name, true AS same_versioned FROM e WHERE b IS NOT NULL")
def same_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """An edge's ends match if one is equal by normalised name and the other is the same entity; a version label is no difference."""
    e = X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"))
    e = e.join(e.select((F.col("id") + 1).alias("id"), F.col("a").alias("b")), "id")
    c = F.concat("a", F.lit(" v"), (F.col("id") % 5).cast("string"), F.lit(".0"))
    return e.select("id", T.endpoints_match(F.col("a"), F.col("a"), F.col("b"), F.col("b")).alias("same_name"), T.endpoints_match(F.col("a"), F.col("b"), c, F.col("b")).alias("same_versioned"))


@query(_q("SELECT id, user_id FROM mem WHERE layer = 'l2_raw' AND dead = 0 AND origin <> 'error' AND id % 3 <> 0 AND date_diff('second', ts, TIMESTAMP '2024-01-08') <= 7 * 86400 AND id % 4 < 3 ORDER BY ts, id LIMIT 20"))
def catchup_batch(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows that wait for extraction, no older than seven days on that day, tried fewer than three times, the oldest twenty."""
    r = X.mem(spark, d).filter("layer = 'l2_raw' and dead = 0 and origin <> 'error' and id % 3 <> 0").withColumn("tries", F.col("id") % 4)
    return r.filter("tries < 3 and timestampdiff(SECOND, ts, timestamp_ntz'2024-01-08 00:00:00') <= 7 * 86400").orderBy("ts", "id").limit(20).select("id", "user_id")


#: The clock of the due rule, so that some failures lie less than a day back.
DUE_AT = "2024-01-01 12:00:00"
_FP = "md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id))"


@query(_q(f"""SELECT user_id, cluster FROM (SELECT user_id, layer AS cluster, count(*) AS members, {_FP} AS fp, {_FP} FILTER (id % 11 <> 0) AS done, {_FP} FILTER (id % 7 <> 0) AS failed, count(*) FILTER (origin = 'click') AS fails, max(ts) FILTER (origin = 'click') AS failed_at FROM mem WHERE dead = 0 GROUP BY 1, 2)
WHERE members >= 2 AND fp IS DISTINCT FROM done AND NOT (fails >= 3 AND failed IS NOT DISTINCT FROM fp AND date_diff('second', failed_at, TIMESTAMP '{DUE_AT}') < 86400)""".replace(f"{_FP} FILTER (id % 11 <> 0)", "md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (id % 11 <> 0))").replace(f"{_FP} FILTER (id % 7 <> 0)", "md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (id % 7 <> 0))")))
def due_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Two members at least, a fingerprint of the members that differs from that of the last pass, and not failed three times on the same members within a day."""
    ids = lambda cond: F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.expr(cond), F.col("id")))), lambda i: i.cast("string")), ","))
    click = F.col("origin") == "click"
    state = X.mem(spark, d).filter("dead = 0").groupBy("user_id", F.col("layer").alias("cluster")).agg(
        F.count("*").alias("members"), ids("true").alias("fp"), ids("id % 11 <> 0").alias("done"), ids("id % 7 <> 0").alias("failed"), F.count(F.when(click, 1)).alias("fails"), F.max(F.when(click, F.col("ts"))).alias("failed_at"),
    )
    recent = F.expr(f"timestampdiff(SECOND, failed_at, timestamp_ntz'{DUE_AT}') < 86400")
    return state.filter((F.col("members") >= 2) & (F.col("fp") != F.col("done")) & ~F.coalesce((F.col("fails") >= 3) & (F.col("failed") == F.col("fp")) & recent, F.lit(False))).select("user_id", "cluster")


@query(_q("SELECT w.rule, count(m.id) AS n FROM (SELECT unnest(['vector', 'clause', 'any', 'exact']) AS rule) w LEFT JOIN mem m ON dead = 0 AND CASE rule WHEN 'vector' THEN (user_id IN ('src1', 'src2') AND agent_id = 'en') OR (user_id = '' AND agent_id = '') WHEN 'clause' THEN user_id IN ('src1', 'src2') AND agent_id = 'en' WHEN 'any' THEN agent_id = 'en' ELSE user_id = 'src1' AND agent_id = '' END GROUP BY 1"))
def owner_rules(spark: SparkSession, d: str) -> DataFrame:
    """which rows an operator sees for owners and agent: with or without nobody's rows, any owner, or exactly one."""
    m = X.mem(spark, d).filter("dead = 0")
    rules = {"vector": T.owned(["src1", "src2"], "en", nobody=True), "clause": T.owned(["src1", "src2"], "en"), "any": T.owned([], "en"), "exact": T.owned(["src1"], "", exact=True)}
    return m.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in rules.items()]).select(F.expr("stack(4, " + ", ".join(f"'{k}', `{k}`" for k in rules) + ") as (rule, n)"))
