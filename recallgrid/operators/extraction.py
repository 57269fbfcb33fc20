"""Extractions applied: what a model's replies about raw rows write and retire, as one change set or as a stream of batches.

A store is rows(id, layer, content, user_id, agent_id, label, ts, source_id, event_at, due_at, embedding, extracted,
superseded_by, how); replies are rows(reply, text, shown, open, vectors): the id of the raw row, the text, the ids of facts and of
intentions that were shown to the model, and a vector for each fact.

Replies of a batch are concurrent: each sees the rows that were live before the batch, and the facts before its own. A row
that several would retire goes to the first, in order of reply and fact. New ids follow from reply and place, so a batch that is
applied again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.functions import text as T
from recallgrid.operators.cluster import similar_pairs
from recallgrid.operators.replies import json_span
from recallgrid.sources.index import saved

REPLY = "facts array<struct<data:string,layer:string,when:string,replaces:array<string>,updates:array<string>>>, intention struct<goal:string,due:string,replaces:array<string>>, intentions_done array<string>"
ROW = "id long, layer string, content string, user_id string, agent_id string, label string, ts timestamp_ntz, source_id long, event_at string, due_at string, embedding array<double>, extracted boolean, superseded_by long, how string"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
#: Ids that a reply can give out, two for each of its facts.
ROOM = 1 << 20
PREFERENCE = "user_preferences"


def known(listed: Column, shown: Column) -> Column:
    """The listed ids (texts) that were shown, each once."""
    ids = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda i: F.trim(i).try_cast("bigint"))
    return F.array_intersect(ids, F.coalesce(shown, F.array().cast("array<bigint>")))


def new_id(place: Column | int) -> Column:
    return -(F.col("reply") * ROOM + place)


def decoded(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """The replies that count, with their raw row's owner and time: JSON, about a live raw row that waits for extraction; of several to one row the first by text."""
    first = F.row_number().over(Window.partitionBy("reply").orderBy("text"))
    r = replies.filter(F.try_parse_json(json_span(F.col("text"))).isNotNull() & (json_span(F.col("text")) != "")).withColumn("_n", first).filter("_n = 1").drop("_n")
    raw = rows.filter("layer = 'l2_raw' and superseded_by is null and not coalesce(extracted, false)").select(F.col("id").alias("reply"), "user_id", "agent_id", "ts")
    return r.join(raw, "reply").withColumn("_r", F.from_json(json_span(F.col("text")), REPLY)).select("reply", "user_id", "agent_id", "ts", "shown", "open", "vectors", "_r.*")


def new_rows(r: DataFrame) -> DataFrame:
    """The rows that decoded replies write, with n (the fact's place), replaces and updates: facts (blank ones don't count), a
    profile row beside each preference, which has no date, and the intention."""
    f = r.select("reply", "user_id", "agent_id", "ts", "shown", "vectors", F.posexplode("facts").alias("n", "f")).filter("coalesce(f.data, '') <> ''")
    pref = F.coalesce(F.col("f.layer") == PREFERENCE, F.lit(False))
    empty = F.array().cast("array<bigint>")
    common = {"content": F.col("f.data"), "source_id": F.col("reply"), "due_at": F.lit(""), "embedding": F.get("vectors", F.col("n")).cast("array<double>"), "extracted": F.lit(None).cast("boolean"), "superseded_by": F.lit(None).cast("long"), "how": F.lit(None).cast("string")}
    replaces = known(F.col("f.replaces"), F.col("shown"))
    facts = f.withColumns(common | {"id": new_id(2 * F.col("n") + 2), "layer": F.lit("l3_fact"), "label": F.coalesce("f.layer", F.lit("")), "event_at": F.when(pref, "").otherwise(T.event_date(F.col("f.when"))), "replaces": replaces, "updates": F.array_except(known(F.col("f.updates"), F.col("shown")), replaces)})
    profile = f.filter(pref).withColumns(common | {"id": new_id(2 * F.col("n") + 3), "layer": F.lit("l1_profile"), "label": F.lit(""), "event_at": F.lit(""), "replaces": empty, "updates": empty})
    goal = r.filter("trim(coalesce(intention.goal, '')) <> ''").withColumns(common | {"content": F.col("intention.goal"), "embedding": F.lit(None).cast("array<double>"), "id": new_id(1), "n": F.lit(-1), "layer": F.lit("l7_intention"), "label": F.lit(""), "event_at": F.lit(""), "due_at": T.event_date(F.col("intention.due")), "replaces": known(F.col("intention.replaces"), F.col("open")), "updates": empty})
    cols = ["reply", "n", "replaces", "updates", *COLUMNS]
    return facts.select(cols).unionByName(profile.select(cols)).unionByName(goal.select(cols))


def restated(rows: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """reply, n, id, by: of each new fact the nearest live fact of its owner and agent, if its cosine reaches least and it has the same numbers."""
    have = ["id", "user_id", "agent_id", "embedding", T.digit_runs(F.col("content")).alias("nums")]
    facts = new.filter("layer = 'l3_fact'").select(*have, "reply", "n")
    stored = rows.filter("layer = 'l3_fact' and superseded_by is null").select(*have)
    both = facts.unionByName(stored, allowMissingColumns=True)
    p = similar_pairs(both, least, ("user_id", "agent_id"), new=F.col("reply").isNotNull())
    # ids of new facts fall in order, so the later of two new ones is a; a stored one may be on either side
    x = facts.select(F.col("id").alias("by"), F.col("reply"), F.col("n"), F.col("nums").alias("mine"))
    late = p.join(x, p.a == x.by).select("by", "reply", "n", "mine", F.col("b").alias("id"), "score")
    early = p.join(facts.select(F.col("id").alias("a")), "a", "left_anti").join(x, F.col("b") == x.by).select("by", "reply", "n", "mine", F.col("a").alias("id"), "score")
    near = late.unionByName(early).groupBy("by").agg(F.max_by(F.struct("id", "reply", "n", "mine"), F.struct("score", -F.col("id"))).alias("x")).select("by", "x.*")
    return near.join(both.select("id", "nums"), "id").filter(F.col("nums") == F.col("mine")).select("reply", "n", "id", "by")


def decisions(rows: DataFrame, r: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """id, superseded_by, how: the first decision about each row, and what follows for the profile rows beside a retired fact."""
    key = ["reply", "n", "o", "id", "by", "how"]
    named = lambda c, o, how: new.select("reply", "n", F.lit(o).alias("o"), F.explode(c).alias("id"), F.col("id").alias("by"), F.lit(how).alias("how"))
    close = F.array_except(known(F.col("intentions_done"), F.col("open")), F.when(F.trim(F.coalesce("intention.goal", F.lit(""))) != "", known(F.col("intention.replaces"), F.col("open"))).otherwise(F.array().cast("array<bigint>")))
    done = r.select("reply", F.lit(-1).alias("n"), F.lit(4).alias("o"), F.explode(close).alias("id"), F.col("reply").alias("by"), F.lit("done").alias("how"))
    same = restated(rows, new, least).withColumn("o", F.lit(1)).withColumn("how", F.lit("restated"))
    every = same.select(key).unionByName(named("replaces", 2, "replaced").select(key)).unionByName(named("updates", 3, "updated").select(key)).unionByName(done)
    first = lambda d: d.groupBy("id").agg(F.min_by(F.struct("by", "how", "reply", "n", "o"), F.struct("reply", "n", "o")).alias("x")).select("id", "x.*")
    one = first(every)
    live = rows.filter("superseded_by is null").select("id", "layer", "user_id", "agent_id", "source_id", "content", F.lit(False).alias("fresh")).unionByName(new.select("id", "layer", "user_id", "agent_id", "source_id", "content", F.lit(True).alias("fresh")))
    gone = live.filter("layer = 'l3_fact' and source_id is not null").join(one, "id").select("source_id", "content", *[c for c in key if c != "id"])
    # the profile row that comes with the new fact itself isn't one of the old fact's
    beside = live.filter("layer = 'l1_profile'").join(gone, ["source_id", "content"]).filter("not fresh or id > by").select(key)
    return saved(first(every.unionByName(beside)).select("id", F.col("by").alias("superseded_by"), "how"), "decisions")


def apply(rows: DataFrame, replies: DataFrame, least: float = 0.92) -> DataFrame:
    """The rows that the replies change or write, in full, as versions of the store's rows."""
    r = saved(decoded(rows, replies), "replies")
    new = saved(new_rows(r), "extracted")
    d = decisions(rows, r, new, least).withColumnsRenamed({"superseded_by": "_by", "how": "_how"})
    read = r.select(F.col("reply").alias("id"), F.lit(True).alias("_read"))
    old = rows.filter("superseded_by is null").join(d, "id", "left").join(read, "id", "left").filter("_by is not null or _read")
    changed = old.withColumns({"extracted": F.coalesce("_read", "extracted"), "superseded_by": F.col("_by"), "how": F.col("_how")})
    added = new.join(d, "id", "left").withColumns({"superseded_by": F.col("_by"), "how": F.col("_how")})
    return changed.select(COLUMNS).unionByName(added.select(COLUMNS))


def versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest version of each changed row, of the batches before one."""
    v = spark.read.schema(f"{ROW}, batch long").parquet(path)
    v = v if before is None else v.filter(F.col("batch") < before)
    return v.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("batch")))).filter("_n = 1").drop("_n", "batch")


def state(rows: DataFrame, changes: DataFrame) -> DataFrame:
    return rows.join(changes.select("id"), "id", "left_anti").select(COLUMNS).unionByName(changes.select(COLUMNS))


def start(rows: DataFrame, replies: DataFrame, path: str, least: float = 0.92):
    """A query (not yet started: a writer) that applies a stream of replies batch by batch; path/rows holds the versions.

    A batch sees the versions of the batches before it and replaces its own folder, so a batch that runs again, after a lost
    driver or a half-written folder, leaves the same rows.
    """

    replies.sparkSession.createDataFrame([], ROW).write.mode("overwrite").parquet(f"{path}/rows/batch=-1")

    def batch(df: DataFrame, k: int) -> None:
        spark = df.sparkSession
        apply(state(rows, versions(spark, f"{path}/rows", k)), df, least).write.mode("overwrite").parquet(f"{path}/rows/batch={k}")

    return replies.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/offsets")
