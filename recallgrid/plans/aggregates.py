"""Counts, medians, fingerprints and usage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.plans.recall import usage
from recallgrid.registry import query


def _q(sql: str) -> str:
    return X.with_views("mem", sql=sql)


def live(spark, d):
    return X.mem(spark, d).filter("dead = 0")


@query(_q("SELECT l.layer, count(m.id) AS n, CASE WHEN count(m.id) > 0 THEN 'ok' ELSE 'empty' END AS health FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in (*X.LAYERS, "l9_none")) + "]) AS layer) l LEFT JOIN mem m ON m.layer = l.layer AND m.dead = 0 GROUP BY 1"))
def layer_counts(spark: SparkSession, d: str) -> DataFrame:
    """A1, A4: live rows of every layer, zero-filled."""
    layers = spark.range(1).select(F.explode(F.array(*map(F.lit, (*X.LAYERS, "l9_none")))).alias("layer"))
    counts = live(spark, d).groupBy("layer").agg(F.count("*").alias("c"))
    return layers.join(counts, "layer", "left").select("layer", F.coalesce("c", F.lit(0)).alias("n"), F.when(F.coalesce("c", F.lit(0)) > 0, "ok").otherwise("empty").alias("health"))


@query(_q("SELECT count(*) AS total, count(*) FILTER (layer = 'l2_raw' AND id % 3 <> 0) AS unextracted, count(DISTINCT user_id) AS owners FROM mem WHERE dead = 0"))
def total_counts(spark: SparkSession, d: str) -> DataFrame:
    """A2, A5, D18."""
    return live(spark, d).agg(F.count("*").alias("total"), F.count(F.when(F.expr("layer = 'l2_raw' and id % 3 <> 0"), 1)).alias("unextracted"), F.countDistinct("user_id").alias("owners"))


@query(_q("SELECT layer, agent_id AS label, count(*) FILTER (dead = 0) AS live, count(*) FILTER (dead = 1) AS hidden FROM mem GROUP BY 1, 2"))
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """A6."""
    return X.mem(spark, d).groupBy("layer", F.col("agent_id").alias("label")).agg(F.count(F.when(F.col("dead") == 0, 1)).alias("live"), F.count(F.when(F.col("dead") == 1, 1)).alias("hidden"))


@query("SELECT id, shown, used FROM (SELECT *, row_number() OVER (ORDER BY used > 0, CASE WHEN used > 0 THEN NULL ELSE shown END, last, id) AS n, count(*) OVER () AS total FROM (SELECT event_id % 200 AS id, count(*) AS shown, count(*) FILTER (event_type = 'click') AS used, max(ts) AS last FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)) WHERE n > total - 150")
def usage_prune(spark: SparkSession, d: str) -> DataFrame:
    """Of many ids the 150 stay that are used or shown most, then seen last."""
    u = usage(spark, d).withColumnRenamed("uid", "id")
    rest = [F.desc(F.col("used") > 0), F.desc_nulls_first(F.when(F.col("used") > 0, None).otherwise(F.col("shown"))), F.desc("last"), F.desc("id")]
    return u.orderBy(*rest).limit(150).select("id", "shown", "used")


@query(_q("SELECT user_id, sha256(concat(string_agg(CAST(id AS VARCHAR), chr(10) ORDER BY CAST(id AS VARCHAR)), chr(10))) AS fingerprint, count(*) AS n FROM mem WHERE layer = 'l3_fact' AND dead = 0 GROUP BY 1"))
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """What a cluster's members hash to."""
    ids = F.sort_array(F.collect_list(F.col("id").cast("string")))
    return live(spark, d).filter("layer = 'l3_fact'").groupBy("user_id").agg(F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")), 256).alias("fingerprint"), F.count("*").alias("n"))


@query("SELECT user_id, round(least(greatest(1.25 * list_sort(list(value))[CAST(floor(len(list(value)) / 2) AS BIGINT) + 1], 3), 80), 6) AS budget FROM (SELECT user_id, value FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8) GROUP BY 1")
def call_budget(spark: SparkSession, d: str) -> DataFrame:
    """From the upper median of the last eight, with a floor and a cap."""
    e = X.table(spark, d, "events").filter("event_type = 'purchase'")
    last = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("n <= 8")
    s = last.groupBy("user_id").agg(F.sort_array(F.collect_list("value")).alias("v"))
    mid = F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int"))
    return s.select("user_id", F.round(F.least(F.greatest(1.25 * mid, F.lit(3.0)), F.lit(80.0)), 6).alias("budget"))


@query(_q("SELECT session_id, count(DISTINCT user_id) >= 2 AS corroborated, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS sources FROM mem WHERE dead = 0 GROUP BY 1"))
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources of a session's rows, and whether there are two."""
    return live(spark, d).groupBy("session_id").agg((F.countDistinct("user_id") >= 2).alias("corroborated"), F.array_join(F.sort_array(F.collect_set("user_id")), ",").alias("sources"))


@query(_q("SELECT user_id, layer AS topic FROM (SELECT user_id, layer, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, layer) AS n FROM mem WHERE dead = 0 GROUP BY 1, 2) WHERE n = 1"))
def schema_topic(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent topic, ties to the lowest."""
    c = live(spark, d).groupBy("user_id", "layer").count()
    return c.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("count"), "layer"))).filter("n = 1").select("user_id", F.col("layer").alias("topic"))


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, count(*) FILTER (value > 50) AS large FROM events GROUP BY 1")
def pass_report(spark: SparkSession, d: str) -> DataFrame:
    """Counters summed up."""
    return X.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.count(F.when(F.col("value") > 50, 1)).alias("large"))


@query(_q("SELECT cluster, owner, round, row_number() OVER (ORDER BY round, (rank_owner + 3) % n_owners, owner) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY newest DESC, cluster) AS round, dense_rank() OVER (ORDER BY owner) - 1 AS rank_owner, (SELECT count(DISTINCT user_id) FROM mem WHERE dead = 0) AS n_owners FROM (SELECT user_id AS owner, concat(user_id, '/', layer) AS cluster, max(ts) AS newest, count(*) AS members FROM mem WHERE dead = 0 GROUP BY 1, 2, layer) WHERE members >= 2)"))
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Due clusters, one of each owner in turn from a rotating start."""
    m = live(spark, d)
    c = m.groupBy(F.col("user_id").alias("owner"), F.concat("user_id", F.lit("/"), "layer").alias("cluster")).agg(F.max("ts").alias("newest"), F.count("*").alias("members")).filter("members >= 2")
    owners = m.agg(F.countDistinct("user_id").alias("n_owners"))
    c = c.withColumn("round", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("newest"), "cluster"))).withColumn("rank_owner", F.dense_rank().over(Window.orderBy("owner")) - 1).crossJoin(F.broadcast(owners))
    return c.select("cluster", "owner", "round", F.row_number().over(Window.orderBy("round", (F.col("rank_owner") + 3) % F.col("n_owners"), "owner")).alias("pos"))
