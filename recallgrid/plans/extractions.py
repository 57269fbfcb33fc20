"""Extractions applied to the store as a stream of reply batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.operators import extraction as E
from recallgrid.registry import query
from recallgrid.sources.index import shared_folder

BATCHES = 3
_COS = "round(list_cosine_similarity(x.embedding, y.embedding), 6)"
_NUMS = "list_sort(list_distinct(regexp_extract_all({}, '([0-9]+)', 1)))"
_STORE = "st0 AS MATERIALIZED (SELECT id, layer, content, concat('u', id % 20) AS user_id, label, ts, id - 20 AS source_id, event_at, '' AS due_at, embedding, origin = 'error' AS extracted, CAST(NULL AS BIGINT) AS superseded_by, CAST(NULL AS VARCHAR) AS how FROM topical WHERE dead = 0)"


def _batch(k: int) -> str:
    old, pref, ids = f"st{k - 1}", "label = 'user_preferences'", "list_filter([{}], lambda i: i % 3 <> 0)"
    none = "CAST(NULL AS BIGINT)"
    return f"""raw{k} AS (SELECT * FROM {old} WHERE layer = 'l2_raw' AND superseded_by IS NULL AND NOT extracted AND id % 5 <> 4 AND id // 160 % {BATCHES} = {k - 1}),
f{k} AS MATERIALIZED (SELECT id AS reply, 0 AS n, -(id * 1048576 + 2) AS id, content, label, user_id, ts, embedding, CASE WHEN {pref} THEN '' ELSE ['2024-01-05', '2024-02', ''][id % 3 + 1] END AS event_at, {ids.format("id + 20, id - 140")} AS rep, {ids.format("id + 180")} AS upd FROM raw{k}
 UNION ALL SELECT id, 1, -(id * 1048576 + 4), concat('Noted: ', content), '', user_id, ts, embedding, '', [], {ids.format("id - 140")} FROM raw{k} WHERE id % 4 = 0),
g{k} AS (SELECT id AS reply, -(id * 1048576 + 1) AS id, concat('finish ', CAST(id AS VARCHAR)) AS content, user_id, ts, CASE WHEN id % 3 = 0 THEN '2024-03-01' ELSE '' END AS due_at FROM raw{k} WHERE id % 2 = 0),
c{k} AS (SELECT id, user_id, embedding, {_NUMS.format("content")} AS nums, true AS fresh FROM f{k} UNION ALL SELECT id, user_id, embedding, {_NUMS.format("content")}, false FROM {old} WHERE layer = 'l3_fact' AND superseded_by IS NULL),
r{k} AS (SELECT new_id, id FROM (SELECT x.id AS new_id, y.id, x.nums = y.nums AS same, row_number() OVER (PARTITION BY x.id ORDER BY {_COS} DESC, y.id) AS k FROM c{k} x JOIN c{k} y ON x.fresh AND x.user_id = y.user_id AND (NOT y.fresh OR y.id > x.id) WHERE {_COS} >= 0.92) WHERE k = 1 AND same),
e{k} AS (SELECT f.reply, f.n, 1 AS o, r.id, r.new_id, 'restated' AS how FROM r{k} r JOIN f{k} f ON f.id = r.new_id UNION ALL SELECT reply, n, 2, unnest(rep), id, 'replaced' FROM f{k} UNION ALL SELECT reply, n, 3, unnest(upd), id, 'updated' FROM f{k}
 UNION ALL SELECT reply, -1, 2, reply + 100, id, 'replaced' FROM g{k} UNION ALL SELECT id, -1, 4, unnest(CASE WHEN id % 2 = 0 THEN [id - 60] ELSE [id - 60, id + 100] END), id, 'done' FROM raw{k}),
m{k} AS (SELECT id, source_id, content, false AS fresh FROM {old} WHERE layer = 'l1_profile' AND superseded_by IS NULL UNION ALL SELECT id - 1, reply, content, true FROM f{k} WHERE {pref}),
lf{k} AS (SELECT id, source_id, content FROM {old} WHERE layer = 'l3_fact' AND superseded_by IS NULL UNION ALL SELECT id, reply, content FROM f{k}),
d1{k} AS (SELECT * FROM e{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY reply, n, o) = 1),
d{k} AS MATERIALIZED (SELECT * FROM (SELECT * FROM e{k} UNION ALL SELECT d.reply, d.n, d.o, m.id, d.new_id, d.how FROM d1{k} d JOIN lf{k} l USING (id) JOIN m{k} m ON m.source_id = l.source_id AND m.content = l.content WHERE NOT m.fresh OR m.id > d.new_id) QUALIFY row_number() OVER (PARTITION BY id ORDER BY reply, n, o) = 1),
n{k} AS (SELECT * FROM {old} UNION ALL SELECT id, 'l3_fact', content, user_id, label, ts, reply, event_at, '', embedding, NULL, {none}, NULL FROM f{k} UNION ALL SELECT id - 1, 'l1_profile', content, user_id, '', ts, reply, '', '', embedding, NULL, {none}, NULL FROM f{k} WHERE {pref} UNION ALL SELECT id, 'l7_intention', content, user_id, '', ts, reply, '', due_at, NULL, NULL, {none}, NULL FROM g{k}),
st{k} AS MATERIALIZED (SELECT n.* REPLACE (CASE WHEN n.id IN (SELECT id FROM raw{k}) THEN true ELSE n.extracted END AS extracted, CASE WHEN n.superseded_by IS NULL THEN d.new_id ELSE n.superseded_by END AS superseded_by, CASE WHEN n.superseded_by IS NULL THEN d.how ELSE n.how END AS how) FROM n{k} n LEFT JOIN d{k} d USING (id))"""


def replies(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """What a model would reply about each raw row: one or two facts (and a blank one), dates of all kinds, ids that weren't shown, an
    intention; every fifth reply isn't JSON."""
    i, s = F.col("id"), lambda *k: F.array(*[F.concat(F.lit(" "), (F.col("id") + x).cast("string")) for x in k])
    fact = lambda data, layer, when, replaces, updates: F.struct(data.alias("data"), layer.alias("layer"), when.alias("when"), replaces.alias("replaces"), updates.alias("updates"))
    none, blank = F.array().cast("array<string>"), F.lit("")
    one = fact(F.col("content"), F.col("label"), F.get(F.array(F.lit(" 2024-01-05T10:00"), F.lit("2024-02"), F.lit("2024-13")), (i % 3).cast("int")), F.concat(s(20, -140), F.array(F.lit("999"), F.lit("x"))), s(20, 180))
    two = fact(F.concat(F.lit("Noted: "), "content"), blank, blank, none, s(-140))
    facts = F.when(i % 4 == 0, F.array(one, two, fact(blank, blank, blank, s(20), none))).otherwise(F.array(one))
    goal = F.struct(F.when(i % 2 == 0, F.concat(F.lit("finish "), i.cast("string"))).otherwise("  ").alias("goal"), F.when(i % 3 == 0, "2024-03-01").otherwise("later").alias("due"), s(100).alias("replaces"))
    text = F.concat(F.lit("Here:\n"), F.to_json(F.struct(facts.alias("facts"), goal.alias("intention"), s(-60, 100).alias("intentions_done"))))
    shown = F.filter(F.array(i + 20, i - 140, i + 180), lambda x: x % 3 != 0)
    r = rows.filter("layer = 'l2_raw'").select(i.alias("reply"), F.when(i % 5 == 4, "I can't {").otherwise(text).alias("text"), shown.alias("shown"), F.array(i + 100, i - 60).alias("open"), F.array("embedding", "embedding").alias("vectors"))
    return r


def store(spark: SparkSession, d: str) -> DataFrame:
    t = X.topical(spark, d).filter("dead = 0")
    return t.select("id", "layer", "content", F.concat(F.lit("u"), F.col("id") % 20).alias("user_id"), F.lit("").alias("agent_id"), "label", F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("id") - 20).alias("source_id"), "event_at", F.lit("").alias("due_at"), F.col("embedding").cast("array<double>").alias("embedding"), (F.col("origin") == "error").alias("extracted"), F.lit(None).cast("long").alias("superseded_by"), F.lit(None).cast("string").alias("how"))


@query(X.with_views("topical", sql=f"+{_STORE}, {', '.join(map(_batch, range(1, BATCHES + 1)))} SELECT id, layer, user_id, label, event_at, due_at, source_id, extracted, superseded_by, how, md5(content) AS body FROM st{BATCHES} s WHERE id < 0 OR superseded_by IS NOT NULL OR " + " OR ".join(f"id IN (SELECT id FROM raw{k})" for k in range(1, BATCHES + 1))))
def apply_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Three batches of replies, streamed, each applied to what the batches before left; the rows they wrote or changed."""
    path = f"{shared_folder(spark)}/extractions-{uuid.uuid4().hex}"
    store(spark, d).write.parquet(f"{path}/store")
    rows = spark.read.parquet(f"{path}/store")
    told = replies(spark, rows)
    for k in range(BATCHES):
        told.filter(F.floor(F.col("reply") / 160) % BATCHES == k).write.mode("append").parquet(f"{path}/replies")
        stream = spark.readStream.schema(told.schema).parquet(f"{path}/replies")
        E.start(rows, stream, path).trigger(availableNow=True).start().awaitTermination()
    return E.versions(spark, f"{path}/rows").select("id", "layer", "user_id", "label", "event_at", "due_at", "source_id", "extracted", "superseded_by", "how", F.md5("content").alias("body"))
