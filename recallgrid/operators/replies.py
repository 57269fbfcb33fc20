"""Proposed edits as data: tolerant decoding and application in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_span(reply: Column) -> Column:
    """From the first brace to the last; fences and prose around go."""
    return F.regexp_extract(reply, "(?s)\\{.*\\}", 0)


def text_field(reply: Column, name: str) -> Column:
    """A field that should be a text: blank if it is of another type, null where the reply isn't JSON."""
    v = F.try_parse_json(json_span(reply))
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(v.isNotNull() & (json_span(reply) != ""), F.when(kind == "STRING", F.try_variant_get(v, f"$.{name}", "string")).otherwise(""))


def list_field(reply: Column, name: str) -> Column:
    """A field that should be a list of texts: empty if it is of another type or the reply isn't JSON."""
    v = F.try_variant_get(F.try_parse_json(json_span(reply)), f"$.{name}", "array<string>")
    return F.coalesce(v, F.array().cast("array<string>"))


RELATIONS = ("related", "contrasts", "same_series")
NOT_RECORDED = "reason not recorded"
OPS = "ops array<struct<op:string,fact:string,targets:array<string>,text:string,relation:string,reason:string>>"


def accepted_ops(replies: DataFrame) -> DataFrame:
    """reply, owner, n, op, fact, targets, text, relation, reason: the ops of each reply that may be applied, in order.

    replies: reply (its number), owner, text, new and shown (ids of new facts and of candidates). Ops name only those; a row that
    an UPDATE or SUPERSEDE has used isn't used again in its reply, and a LINK touches no used row. The walk is a fold over one
    reply's list, so it is as parallel as there are replies. What isn't JSON, or has wrong types, gives no ops.
    """
    ids = lambda x: F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda i: i.try_cast("bigint")), lambda i: i.isNotNull())
    ops = F.coalesce(F.from_json(json_span(F.col("text")), OPS)["ops"], F.array().cast("array<struct<op:string,fact:string,targets:array<string>,text:string,relation:string,reason:string>>"))
    clean = lambda x: F.trim(F.coalesce(x, F.lit("")))
    one = lambda o, n: F.struct(n.alias("n"), F.upper(clean(o["op"])).alias("op"), F.trim(o["fact"]).try_cast("bigint").alias("fact"), ids(o["targets"]).alias("targets"), clean(o["text"]).alias("text"), F.lower(clean(o["relation"])).alias("relation"), clean(o["reason"]).alias("reason"))
    r = replies.select("reply", "owner", "new", "shown", F.transform(ops, one).alias("ops"))
    r = r.withColumn("ops", F.filter("ops", lambda o: F.coalesce(F.array_contains("new", o["fact"]), F.lit(False))))
    known = lambda o: F.array_distinct(F.filter(o["targets"], lambda t: F.array_contains("shown", t)))
    r = r.withColumn("ops", F.transform("ops", lambda o: o.withField("targets", known(o))))

    def step(acc: Column, o: Column) -> Column:
        free = F.array_except(o["targets"], acc["used"])
        again = F.array_contains(acc["used"], o["fact"])
        link = (o["op"] == "LINK") & o["relation"].isin(*RELATIONS) & (F.size(o["targets"]) > 0) & ~again & (F.size(free) == F.size(o["targets"]))
        change = ((o["op"] == "SUPERSEDE") | (o["op"] == "UPDATE") & (o["text"] != "")) & (F.size(free) > 0) & ~again
        used = F.when(change, F.concat(acc["used"], F.array(o["fact"]), free)).otherwise(acc["used"])
        out = F.when(link, F.concat(acc["out"], F.array(o))).when(change, F.concat(acc["out"], F.array(o.withField("targets", free)))).otherwise(acc["out"])
        return F.struct(used.alias("used"), out.alias("out"))

    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.slice("ops", 1, 0).alias("out"))
    folded = r.select("reply", "owner", F.aggregate("ops", start, step, lambda acc: acc["out"]).alias("out"))
    return folded.select("reply", "owner", F.inline("out"))


def reconciled(rows: DataFrame, ops: DataFrame) -> DataFrame:
    """What accepted ops change in live rows (id, ts, label, event_at): change, id, other, how, detail.

    written: the merged row of an UPDATE (its id follows from reply and n), with the label of its fact (detail: text) and the event
    date of the newest row involved (how); retired: by the first op that takes the row; linked: an entry for each side.
    """
    merged = -(F.col("reply") * 1000 + F.col("n") + 1)
    ops = ops.withColumn("merged", F.when(F.col("op") == "UPDATE", merged))
    update = ops.filter("op = 'UPDATE'")
    involved = update.select("merged", "fact", "text", F.explode(F.array_union(F.array("fact"), "targets")).alias("id")).join(rows.select("id", "ts", "label", "event_at"), "id")
    written = involved.groupBy("merged").agg(F.max(F.when(F.col("id") == F.col("fact"), F.col("label"))).alias("label"), F.max_by("event_at", F.struct("ts", "id")).alias("how"), F.first("text").alias("text"))
    written = written.select(F.lit("written").alias("change"), F.col("merged").alias("id"), F.lit(None).cast("long").alias("other"), "how", F.concat_ws(": ", "label", "text").alias("detail"))
    retire = ops.filter("op <> 'LINK'").select("reply", "n", F.explode(F.when(F.col("op") == "UPDATE", F.array_union(F.array("fact"), "targets")).otherwise(F.col("targets"))).alias("id"), F.coalesce("merged", "fact").alias("other"), F.when(F.col("op") == "UPDATE", "updated").otherwise("replaced").alias("how"), F.when(F.col("op") == "SUPERSEDE", F.when(F.col("reason") == "", NOT_RECORDED).otherwise(F.col("reason"))).otherwise("").alias("detail"))
    retired = retire.groupBy("id").agg(F.min_by(F.struct("other", "how", "detail"), F.struct("reply", "n")).alias("x")).join(rows.select("id"), "id", "left_semi").select(F.lit("retired").alias("change"), "id", "x.*")
    link = ops.filter("op = 'LINK'").select("fact", "relation", F.explode("targets").alias("t"))
    both = link.select(F.col("fact").alias("id"), F.col("t").alias("other"), F.col("relation").alias("relation")).unionByName(link.select(F.col("t").alias("id"), F.col("fact").alias("other"), "relation")).distinct()
    linked = both.join(rows.select("id"), "id", "left_semi").select(F.lit("linked").alias("change"), "id", "other", F.col("relation").alias("how"), F.lit("").alias("detail"))
    return written.unionByName(retired).unionByName(linked)
