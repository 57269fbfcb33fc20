"""Versioned rows: superseding, restoring, history, forgetting, decay, links and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.functions import text as T
from recallgrid.operators import cluster
from recallgrid.operators import lifecycle as L
from recallgrid.operators.cluster import similar_pairs
from recallgrid.operators.nearest import nearest
from recallgrid.operators.replies import accepted_ops, reconciled
from recallgrid.registry import query
from recallgrid.sources import ingest


def _q(sql: str) -> str:
    return X.with_views("mem", "retired", sql=sql)


def marked(spark: SparkSession, d: str) -> DataFrame:
    none = {c: F.lit(None).cast("string") for c in ("invalid_at", "how", "reason")}
    rows = X.mem(spark, d).withColumns(none).withColumn("superseded_by", F.lit(None).cast("long"))
    return L.supersede(rows, X.retired(spark, d).withColumns({"how": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")}), X.NOW)


@query(_q(f"SELECT m.id, CASE WHEN r.id IS NOT NULL THEN '{X.NOW}' END AS invalid_at, r.superseded_by, CASE WHEN r.id IS NOT NULL THEN 'replaced' END AS how FROM mem m LEFT JOIN retired r USING (id)"))
def supersede(spark: SparkSession, d: str) -> DataFrame:
    """M1."""
    return marked(spark, d).select("id", "invalid_at", "superseded_by", "how")


@query(_q(f"SELECT m.id, CASE WHEN r.id IS NOT NULL AND m.id % 2 = 0 THEN '{X.NOW}' END AS restored_at, CASE WHEN m.id % 2 = 1 THEN r.superseded_by END AS superseded_by FROM mem m LEFT JOIN retired r USING (id)"))
def restore(spark: SparkSession, d: str) -> DataFrame:
    """M2: even ids come back."""
    m = marked(spark, d)
    return L.restore(m, m.filter("id % 2 = 0").select("id"), X.NOW).select("id", "restored_at", "superseded_by")


@query(X.with_views("mem", "retired", sql=", ").replace("WITH ", "WITH RECURSIVE ").rstrip(" ,") + ", c AS (SELECT id, superseded_by AS last, 1 AS n FROM retired UNION ALL SELECT c.id, r.superseded_by, n + 1 FROM c JOIN retired r ON r.id = c.last WHERE n < 10000) SELECT id, last FROM c WHERE last NOT IN (SELECT id FROM retired)")
def successor_chain(spark: SparkSession, d: str) -> DataFrame:
    """The row that a chain of replacements ends at."""
    return L.chain_ends(X.retired(spark, d))


@query(_q("SELECT superseded_by AS id, r.id AS old_id, k FROM (SELECT r.*, row_number() OVER (PARTITION BY superseded_by ORDER BY m.ts DESC, r.id DESC) AS k FROM retired r JOIN mem m USING (id)) r WHERE k <= 2"))
def history(spark: SparkSession, d: str) -> DataFrame:
    """The two newest rows that each row replaced."""
    r = X.retired(spark, d).join(X.mem(spark, d).select("id", "ts"), "id")
    k = F.row_number().over(Window.partitionBy("superseded_by").orderBy(F.desc("ts"), F.desc("id")))
    return r.withColumn("k", k).filter("k <= 2").select(F.col("superseded_by").alias("id"), F.col("id").alias("old_id"), "k")


SOURCES = "src AS (SELECT id, layer, dead, [id - 20, id - 40] AS sources FROM mem)"


def sourced(spark: SparkSession, d: str) -> DataFrame:
    return X.mem(spark, d).withColumn("sources", F.array(F.col("id") - 20, F.col("id") - 40))


@query(_q(f"+{SOURCES}, raw AS (SELECT id FROM mem WHERE layer = 'l2_raw' AND id % 5 = 0) SELECT id FROM raw UNION SELECT s.id FROM (SELECT id, unnest(sources) AS s FROM src WHERE layer <> 'l2_raw' AND dead = 0) s JOIN raw ON raw.id = s.s"))
def forget(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows and what is derived from them."""
    s = sourced(spark, d)
    return L.forget(s.filter("layer <> 'l2_raw' and dead = 0"), s.filter("layer = 'l2_raw' and id % 5 = 0").select("id"))


@query(_q(f"+{SOURCES} SELECT id FROM mem WHERE layer = 'l2_raw' AND ts < TIMESTAMP '2024-01-25' AND id % 3 <> 0 AND id NOT IN (SELECT unnest(sources) FROM src WHERE layer = 'l3_fact' AND dead = 0)"))
def raw_decay(spark: SparkSession, d: str) -> DataFrame:
    """M7: old extracted raw rows that no live fact cites."""
    s = sourced(spark, d)
    raw = s.filter("layer = 'l2_raw'").withColumn("extracted", F.col("id") % 3 != 0)
    return L.decay(raw, s.filter("layer = 'l3_fact' and dead = 0").select(F.explode("sources").alias("id")), "2024-01-25 00:00:00").select("id")


@query(_q(f"+{SOURCES} SELECT s.id AS schema_id, count(DISTINCT f.id) AS cites FROM (SELECT id, unnest(sources) AS s FROM src WHERE layer IN ('l4_summary', 'l5_knowledge')) s JOIN mem f ON f.id = s.s AND f.layer = 'l3_fact' AND f.dead = 0 GROUP BY 1"))
def schemas_by_evidence(spark: SparkSession, d: str) -> DataFrame:
    """How many live facts a schema cites."""
    e = sourced(spark, d).filter("layer in ('l4_summary', 'l5_knowledge')").select(F.col("id").alias("schema_id"), F.explode("sources").alias("id"))
    facts = X.mem(spark, d).filter("layer = 'l3_fact' and dead = 0").select("id")
    return e.join(facts, "id").groupBy("schema_id").agg(F.countDistinct("id").alias("cites"))


@query(_q("SELECT a.id AS hit, b.id AS linked, a.n AS pos FROM (SELECT id, unnest([id + 160, id + 320]) AS t, unnest([1, 2]) AS n FROM mem WHERE layer = 'l3_fact' AND dead = 0 AND id % 20 = 0) a JOIN mem b ON b.id = a.t AND b.layer = 'l3_fact' AND b.dead = 0 WHERE b.id NOT IN (SELECT id FROM mem WHERE layer = 'l3_fact' AND dead = 0 AND id % 20 = 0)"))
def linked_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts that hits link to and that aren't hits themselves."""
    from recallgrid.functions.text import links

    facts = X.mem(spark, d).filter("layer = 'l3_fact' and dead = 0").select("id")
    hits = facts.filter("id % 20 = 0")
    text = F.concat((F.col("id") + 160).cast("string"), F.lit(":related, bad,"), (F.col("id") + 320).cast("string"), F.lit(":contrasts"))
    asked = hits.select(F.col("id").alias("hit"), F.posexplode(links(text)).alias("k", "l")).select("hit", F.col("l.id").cast("long").alias("id"), (F.col("k") + 1).alias("pos"))
    return asked.join(facts, "id").join(hits, "id", "left_anti").select("hit", F.col("id").alias("linked"), "pos")


@query(_q("SELECT id, version, content FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS n FROM (SELECT id, 1 AS version, content, false AS deleted FROM mem UNION ALL SELECT id, 2, concat('new ', content), id % 10 = 0 FROM mem WHERE id % 5 = 0)) WHERE n = 1 AND NOT deleted"))
def version_log(spark: SparkSession, d: str) -> DataFrame:
    """Rewrites and deletions as next versions, and the current rows."""
    log = X.mem(spark, d).select("id", F.lit(1).alias("version"), "content", F.lit(False).alias("deleted"))
    change = log.filter("id % 5 = 0").select("id", F.concat(F.lit("new "), "content").alias("content"), (F.col("id") % 10 == 0).alias("deleted"), F.lit(1).alias("expected"))
    return ingest.latest(ingest.append(log, change)).select("id", "version", "content")


@query(_q("SELECT id, CASE WHEN dead = 1 THEN label WHEN id % 2 = 0 THEN NULL ELSE label END AS label, CASE WHEN dead = 1 THEN 'no' ELSE 'yes' END AS extracted, CASE WHEN dead = 0 AND id % 3 = 0 THEN 'x' ELSE agent_id END AS agent_id FROM (SELECT id, dead, nullif(label, '') AS label, agent_id FROM mem)"))
def meta_patch(spark: SparkSession, d: str) -> DataFrame:
    """On live rows keys are set, and removed by an empty value; the owner's columns follow only where they are named."""
    m = X.mem(spark, d).withColumn("meta", ingest.patch_meta(F.create_map().cast("map<string,string>"), F.create_map(F.lit("label"), F.col("label"), F.lit("extracted"), F.lit("no"))))
    change = F.map_concat(F.create_map(F.lit("extracted"), F.lit("yes")), F.when(F.col("id") % 2 == 0, F.create_map(F.lit("label"), F.lit(""))).otherwise(F.create_map().cast("map<string,string>")), F.when(F.col("id") % 3 == 0, F.create_map(F.lit("agent_id"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")))
    live = F.col("dead") == 0
    agent = F.when(live & F.map_contains_key(change, "agent_id"), change["agent_id"]).otherwise(F.col("agent_id"))
    p = m.withColumn("agent_id", agent).withColumn("meta", F.when(live, ingest.patch_meta(F.col("meta"), change)).otherwise(F.col("meta")))
    return p.select("id", F.col("meta")["label"].alias("label"), F.col("meta")["extracted"].alias("extracted"), "agent_id")


@query("SELECT user_id AS page, event_type AS attr, since, old_value, new_value FROM (SELECT user_id, event_type, ts AS since, lag(round(value, 2)) OVER w AS old_value, round(value, 2) AS new_value FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE old_value IS NOT NULL AND old_value <> new_value")
def page_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed in an entity's state, and when."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = X.table(spark, d, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("attr"), F.col("ts").alias("since"), F.lag(F.round("value", 2)).over(w).alias("old_value"), F.round("value", 2).alias("new_value"))
    return e.filter("old_value is not null and old_value <> new_value")


@query("SELECT page, string_agg(concat(attr, ': ', CAST(n AS VARCHAR)), chr(10) ORDER BY attr) AS content FROM (SELECT user_id AS page, event_type AS attr, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def page_documents(spark: SparkSession, d: str) -> DataFrame:
    """One text of each page's state."""
    s = X.table(spark, d, "events").groupBy(F.col("user_id").alias("page"), F.col("event_type").alias("attr")).agg(F.count("*").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("attr", "n"))), lambda x: F.concat(x["attr"], F.lit(": "), x["n"].cast("string")))
    return s.groupBy("page").agg(F.array_join(lines, "\n").alias("content"))


@query(_q("SELECT id, keep FROM (SELECT id, min(id) OVER (PARTITION BY user_id, lower(trim(content))) AS keep FROM mem WHERE dead = 0)"))
def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    """M14 for equal texts."""
    return X.mem(spark, d).filter("dead = 0").select("id", F.min("id").over(Window.partitionBy("user_id", F.lower(F.trim("content")))).alias("keep"))


NEAR = 0.92
_COS = "round(list_cosine_similarity(a.embedding, b.embedding), 6)"
_LIVE = "live AS (SELECT *, list_sort(list_distinct(regexp_extract_all(content, '([0-9]+)', 1))) AS nums FROM topical WHERE dead = 0)"
_PAIRS = f"pairs AS (SELECT a.id AS a, b.id AS b, {_COS} AS score, a.nums = b.nums AS same FROM live a JOIN live b ON a.user_id = b.user_id AND a.id < b.id WHERE {_COS} >= {{least}})"


def live(spark: SparkSession, d: str) -> DataFrame:
    """Live rows with vectors of topics and their sets of numbers."""
    return X.topical(spark, d).filter("dead = 0").withColumn("nums", T.digit_runs(F.col("content")))


@query(X.with_views("topical", sql=f"+{_LIVE}, {_PAIRS.format(least=NEAR)} SELECT a, b, score FROM pairs"))
def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near copies among the rows of one owner."""
    return similar_pairs(live(spark, d), NEAR)


@query(X.with_views("topical", sql=f"+{_LIVE}, {_PAIRS.format(least=NEAR)} SELECT a, b, score FROM pairs WHERE same"))
def near_pairs_same_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Near copies of one owner with the same set of numbers, which is part of the join's key."""
    nums = T.digit_runs(F.col("text"))
    # a set of numbers travels as its hashes; no text without a set
    rows, v, heads = X.topical_named(spark, d, F.when(nums.isNotNull(), F.struct(F.xxhash64(nums).alias("x"), F.hash(nums).alias("h"))))
    rows, named = rows.filter("dead = 0 and content is not null").select("id", "user_id", "content", "v", "t", "w"), cluster.Named(v, heads)
    return similar_pairs(rows, NEAR, ("user_id", "content"), named=named) if v.count() <= cluster.FEW_VECTORS else similar_pairs(cluster.held(rows, named), NEAR, ("user_id", "content"))


#: Windows of production hold 50 facts, clusters 5 at least; owners of the test tables have fewer rows than that.
BATCH, SMALL = 6, 3
_PLACED = "plc AS (SELECT user_id, id, nums, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) - 1 AS o, count(*) OVER (PARTITION BY user_id) AS n FROM live)"
_NEAR = "nn AS (SELECT user_id, o, list(j ORDER BY k) AS near FROM (SELECT x.user_id, x.o, y.o AS j, x.nums = y.nums AS same, row_number() OVER (PARTITION BY x.id ORDER BY p.score DESC, y.id) AS k FROM (SELECT a, b, score FROM pairs UNION ALL SELECT b, a, score FROM pairs) p JOIN plc x ON x.id = p.a JOIN plc y ON y.id = p.b) WHERE k < {k} AND {also} GROUP BY 1, 2)"
_CLUSTERED = f"""{_LIVE}, {_PAIRS.format(least=0.55)}, {_PLACED}, {_NEAR.format(k=2 * BATCH, also="true")},
wk AS (SELECT user_id, n, 0::BIGINT AS i, []::BIGINT[] AS used, []::BIGINT[] AS members FROM (SELECT DISTINCT user_id, n FROM plc WHERE n > {BATCH})
  UNION ALL SELECT user_id, n, i + 1, list_concat(used, m), m FROM (SELECT w.*, CASE WHEN list_contains(used, i) THEN [] ELSE list_prepend(i, list_slice(list_filter(coalesce(near, []), lambda j: NOT list_contains(used, j)), 1, {BATCH - 1})) END AS m FROM wk w LEFT JOIN nn ON nn.user_id = w.user_id AND nn.o = w.i WHERE i < n)),
tp AS (SELECT user_id, members, row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS c FROM wk WHERE len(members) >= {SMALL}),
ro AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS m FROM (SELECT user_id, unnest(members) AS o FROM wk WHERE len(members) BETWEEN 1 AND {SMALL - 1} UNION ALL SELECT user_id, o FROM plc WHERE n <= {BATCH})),
ck AS (SELECT user_id, c, CASE WHEN c > 0 AND (c + 1) * {BATCH} > m THEN m - {BATCH} ELSE c * {BATCH} END AS lo, least((c + 1) * {BATCH}, m) AS hi FROM (SELECT user_id, m, unnest(range((m + {BATCH - 1}) // {BATCH})) AS c FROM (SELECT DISTINCT user_id, m FROM ro))),
cl AS (SELECT user_id, c AS cluster, true AS topic, unnest(members) AS o FROM tp UNION ALL SELECT r.user_id, k.c + coalesce(t.n, 0), false, r.o FROM ro r JOIN ck k ON k.user_id = r.user_id AND r.p >= k.lo AND r.p < k.hi LEFT JOIN (SELECT user_id, count(*) AS n FROM tp GROUP BY 1) t ON t.user_id = r.user_id)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(_recursive(X.with_views("topical", sql=f"+{_CLUSTERED} SELECT c.user_id, cluster, topic, id FROM cl c JOIN plc USING (user_id, o)")))
def greedy_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Topic clusters in the order of their seeds, then the others in full chunks by time."""
    return cluster.greedy_clusters(live(spark, d), batch=BATCH, small=SMALL)


@query()
def cluster_sync(spark: SparkSession, d: str) -> DataFrame:
    """Stored clusters, of facts that were there before, after some facts left and others came."""
    facts = X.topical(spark, d)
    old = facts.filter("id % 3 <> 0").select("user_id", (F.col("id") % 2).cast("int").alias("cluster"), (F.col("id") % 2 == 0).alias("topic"), "id")
    return cluster.synced(facts.filter("dead = 0"), old, batch=BATCH)


_DEDUPED = f"""{_LIVE}, {_PAIRS.format(least=NEAR)}, {_PLACED}, {_NEAR.format(k=6, also="same AND j > o")},
wk AS (SELECT user_id, n, 0::BIGINT AS i, []::BIGINT[] AS gone, []::BIGINT[] AS out_ FROM (SELECT DISTINCT user_id, n FROM plc)
  UNION ALL SELECT user_id, n, i + 1, list_concat(gone, m), m FROM (SELECT w.*, CASE WHEN list_contains(gone, i) THEN [] ELSE list_filter(coalesce(near, []), lambda j: NOT list_contains(gone, j)) END AS m FROM wk w LEFT JOIN nn ON nn.user_id = w.user_id AND nn.o = w.i WHERE i < n))"""


@query(_recursive(X.with_views("topical", sql=f"+{_DEDUPED} SELECT g.id, s.id AS superseded_by FROM (SELECT user_id, i - 1 AS so, unnest(out_) AS o FROM wk) w JOIN plc g ON g.user_id = w.user_id AND g.o = w.o JOIN plc s ON s.user_id = w.user_id AND s.o = w.so")))
def dedupe_facts(spark: SparkSession, d: str) -> DataFrame:
    """The newest survives, older near copies with the same numbers are superseded."""
    return cluster.greedy_dedupe(live(spark, d))


RELATED = 0.70
#: What a model would reply about a new fact and its nearest candidates: every kind of op, unknown ids, blank texts, wrong relations.
_OPS = """[{'n': 0, 'op': 'LINK', 'fact': fact, 't': [c[1], c[2]], 'text': '', 'rel': CASE WHEN fact % 3 = 0 THEN 'cousin' ELSE 'related' END, 'why': ''},
 {'n': 1, 'op': 'UPDATE', 'fact': fact, 't': [c[2], 999999999], 'text': CASE WHEN fact % 20 = 0 THEN '' ELSE concat('merged ', CAST(fact AS VARCHAR)) END, 'rel': '', 'why': ''},
 {'n': 2, 'op': 'SUPERSEDE', 'fact': fact, 't': [c[2], c[3]], 'text': '', 'rel': '', 'why': CASE WHEN fact % 40 = 0 THEN 'newer' ELSE '' END},
 {'n': 3, 'op': 'LINK', 'fact': c[1], 't': [c[4]], 'text': '', 'rel': 'contrasts', 'why': ''},
 {'n': 4, 'op': 'SUPERSEDE', 'fact': c[1], 't': [c[3], c[4], c[5]], 'text': '', 'rel': '', 'why': ' older '},
 {'n': 5, 'op': 'LINK', 'fact': c[1], 't': [c[6]], 'text': '', 'rel': 'same_series', 'why': ''}]"""
_SHOWN = f"{_LIVE}, {_PAIRS.format(least=RELATED)}, cd AS (SELECT fact, list(id ORDER BY score DESC, id)[1:8] AS c FROM (SELECT a AS fact, b AS id, score FROM pairs UNION ALL SELECT b, a, score FROM pairs) WHERE fact % 10 = 0 GROUP BY 1)"
_ACCEPTED = f"""{_SHOWN}, op AS (SELECT fact AS reply, c, unnest({_OPS}) AS o FROM cd),
ot AS (SELECT reply, o.n AS n, o.op AS op, o.fact AS fact, list_filter(o.t, lambda t: list_contains(c, t)) AS t, o.text AS text, o.rel AS rel, trim(o.why) AS why FROM op WHERE o.fact IS NOT NULL),
fo AS (SELECT reply, 0::BIGINT AS i, []::BIGINT[] AS used, false AS ok, []::BIGINT[] AS got FROM (SELECT DISTINCT reply FROM ot)
  UNION ALL SELECT reply, i + 1, CASE WHEN ok2 AND op <> 'LINK' THEN list_concat(used, [fact], free) ELSE used END, ok2, CASE WHEN op = 'LINK' THEN t ELSE free END FROM (SELECT *, CASE WHEN list_contains(used, fact) THEN false WHEN op = 'LINK' THEN rel IN ('related', 'contrasts', 'same_series') AND len(t) > 0 AND len(free) = len(t) WHEN op = 'UPDATE' THEN text <> '' AND len(free) > 0 ELSE len(free) > 0 END AS ok2
    FROM (SELECT f.reply, f.i, f.used, coalesce(o.op, '') AS op, o.fact, coalesce(o.t, []) AS t, o.text, o.rel, list_filter(coalesce(o.t, []), lambda x: NOT list_contains(f.used, x)) AS free FROM fo f LEFT JOIN ot o ON o.reply = f.reply AND o.n = f.i WHERE f.i < 6))),
ac AS (SELECT o.*, f.got FROM fo f JOIN ot o ON o.reply = f.reply AND o.n = f.i - 1 WHERE f.ok),
iv AS (SELECT reply, n, fact, text, -(reply * 1000 + n + 1) AS merged, unnest(list_distinct(list_prepend(fact, got))) AS id FROM ac WHERE op = 'UPDATE')"""


@query(_recursive(X.with_views("topical", sql=f"""+{_ACCEPTED}
SELECT 'written' AS change, merged AS id, CAST(NULL AS BIGINT) AS other, arg_max(l.event_at, (l.ts, l.id)) AS how, concat(max(CASE WHEN l.id = fact THEN label END), ': ', any_value(text)) AS detail FROM iv JOIN live l USING (id) GROUP BY merged
UNION ALL SELECT 'retired', id, other, how, detail FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY reply, n) AS k FROM (SELECT reply, n, id, merged AS other, 'updated' AS how, '' AS detail FROM iv UNION ALL SELECT reply, n, unnest(got), fact, 'replaced', CASE WHEN why = '' THEN 'reason not recorded' ELSE why END FROM ac WHERE op = 'SUPERSEDE')) WHERE k = 1
UNION ALL SELECT DISTINCT 'linked', id, other, rel, '' FROM (SELECT fact AS id, unnest(got) AS other, rel FROM ac WHERE op = 'LINK' UNION ALL SELECT unnest(got), fact, rel FROM ac WHERE op = 'LINK')""")))
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Replies about new facts and their candidates (0.70 or nearer, eight at most), decoded and applied: merged rows, retired rows, links."""
    rows = live(spark, d)
    near = nearest(rows.filter("id % 10 = 0"), rows, 8, ("user_id",), RELATED, digits=6).select(F.col("x").alias("fact"), F.col("y").alias("id"), "score", "k")
    c = near.groupBy("fact").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("c"))
    at = lambda *k: F.array(*[F.get("c", F.lit(i - 1)).cast("string") for i in k])
    f, first, blank = F.col("fact").cast("string"), F.get("c", F.lit(0)).cast("string"), F.lit("")
    op = lambda name, fact, targets, text=blank, rel=blank, why=blank: F.struct(F.lit(name).alias("op"), fact.alias("fact"), targets.alias("targets"), text.alias("text"), rel.alias("relation"), why.alias("reason"))
    ops = F.array(
        op("link", f, at(1, 2), rel=F.when(F.col("fact") % 3 == 0, "cousin").otherwise("Related")), op("UPDATE", f, F.concat(at(2), F.array(F.lit("999999999"))), F.when(F.col("fact") % 20 == 0, " ").otherwise(F.concat(F.lit("merged "), f))),
        op(" supersede", f, at(2, 3), why=F.when(F.col("fact") % 40 == 0, "newer").otherwise("")), op("LINK", first, at(4), rel=F.lit("contrasts")), op("SUPERSEDE", first, at(3, 4, 5), why=F.lit(" older ")), op("LINK", first, at(6), rel=F.lit("same_series")),
    )
    replies = c.select(F.col("fact").alias("reply"), F.lit("").alias("owner"), F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(ops.alias("ops"))), F.lit("\n```")).alias("text"), F.array_union(F.array("fact"), F.slice("c", 1, 1)).alias("new"), F.col("c").alias("shown"))
    return reconciled(rows, accepted_ops(replies))
