"""Sources and sinks: ingestion with origin policies and the version log of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: origin: (extract, forgettable); any other origin is extracted and not forgettable.
POLICIES = {"memory_tool": (True, True), "doctor": (False, False)}


def with_policy(rows: DataFrame, policies: dict[str, tuple[bool, bool]] | None = None) -> DataFrame:
    """extract_wanted and forgettable by origin: a lookup that folds into the projection."""
    extract, forget = F.lit(True), F.lit(False)
    for origin, (e, f) in (POLICIES if policies is None else policies).items():
        extract = F.when(F.col("origin") == origin, e).otherwise(extract)
        forget = F.when(F.col("origin") == origin, f).otherwise(forget)
    return rows.withColumn("extract_wanted", extract).withColumn("forgettable", forget)


def latest(log: DataFrame) -> DataFrame:
    """The current row of each id of an append-only version log (id, version, deleted, ...)."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("version")))
    return log.withColumn("_n", n).filter("_n = 1 and not deleted").drop("_n")


def append(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with changes as the next version of their ids; a change whose expected version isn't current is left out."""
    now = log.groupBy("id").agg(F.max("version").alias("_now"))
    fit = changes.join(now, "id", "left").filter(F.col("expected").isNull() | (F.col("expected") == F.coalesce("_now", F.lit(0))))
    return log.unionByName(fit.withColumn("version", F.coalesce("_now", F.lit(0)) + 1).drop("_now", "expected"))


def patch_meta(meta: F.Column, changes: F.Column) -> F.Column:
    """Keys set by changes; an empty value removes the key."""
    kept = F.map_filter(meta, lambda k, v: ~F.map_contains_key(changes, k))
    return F.map_filter(F.map_concat(kept, changes), lambda k, v: v != "")


def write_rows(rows: DataFrame, path: str) -> None:
    """The store's layout: Parquet by layer."""
    rows.write.mode("append").partitionBy("layer").parquet(path)


def open_rows(spark, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def checked(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """layer, n, complete: each layer's rows held against the stored counts (layer, n)."""
    now = rows.groupBy("layer").agg(F.count("*").alias("_n"))
    return counts.join(now, "layer", "full").select("layer", F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce(F.col("_n") == F.col("n"), F.lit(False)).alias("complete"))


def accepted(rows: DataFrame) -> DataFrame:
    """Raw rows of an add: text, or else data, is the content; rows without either are refused."""
    text = F.when(F.trim("text") != "", F.col("text"))
    out = with_policy(rows.withColumn("content", F.coalesce(text, F.col("data"))).filter("content is not null"))
    return out.withColumn("layer", F.lit("l2_raw"))


def rewrite(rows: DataFrame, new: DataFrame, layer: str) -> DataFrame:
    """rows with the content of new (id, new) where they are live and of the layer; embed_again marks them."""
    out = rows.join(new, "id", "left")
    hit = F.coalesce((F.col("layer") == layer) & (F.col("dead") == 0) & F.col("new").isNotNull(), F.lit(False))
    return out.withColumn("content", F.when(hit, F.col("new")).otherwise(F.col("content"))).withColumn("embed_again", hit).drop("new")
