"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Sizes are summed by source and hash bucket. A source's target is whole passes over it plus a rest;
the rest's budget is a threshold on the hash, found by nested histograms: the bucket in which the
budget ends is divided again, and only that one. Documents below the threshold are taken once more.
Nothing is sorted but the few buckets of a source, and reruns agree, as the hash is of doc_id. Rows meet
what is known of their source by attach(), so a hot source is never gathered. Only the list of sources, a
row of 50 bytes for each, is ordered in one task.

Defined results: null and empty texts have size 0 and are taken 0 times their size; null source is a
source of its own, last in order; rows with the same doc_id are taken alike, repeated rows too; a null doc_id
hashes as the empty string; a text of any length counts whole; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import WORD_SPLIT, attach, documents, stage

# Weights by place of the source, the share of all sizes, and the most times a source is taken.
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Hash digits (base 16) of each level of the histograms.
LEVELS = (3, 3, 3, 3)


def _hash(level: int) -> Column:
    """The level's bucket, from the MD5 of doc_id."""
    at = 1 + sum(LEVELS[:level])
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), at, LEVELS[level]), 16, 10).cast("int")


def targets(sizes: DataFrame) -> DataFrame:
    """source, docs, source_size, target for sizes(source, size): shares by weight, filled up to the limits."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # one row a source from here on: the windows without a key are as long as the list of sources
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = s.withColumn("weight", weight.cast("double"))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("done_size", F.coalesce(F.sum("source_size").over(full), F.lit(0)).cast("double")).withColumn("done_weight", F.coalesce(F.sum("weight").over(full), F.lit(0.0)))
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_weight", F.sum("weight").over(every))
    # the level of water if the sources before this one are full; the first that isn't above its limit holds for it and the rest
    s = s.withColumn("level", (SHARE * F.col("total") - MOST * F.col("done_size")) / (F.col("all_weight") - F.col("done_weight")))
    s = s.withColumn("fits", F.col("level") * F.col("weight") <= MOST * F.col("source_size"))
    s = s.withColumn("water", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(every)["level"])
    return s.select("source", "docs", "source_size", F.when(F.col("total") == 0, 0.0).otherwise(F.least(F.col("water") * F.col("weight"), MOST * F.col("source_size").cast("double"))).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for each row of docs (doc_id, text, source)."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WORD_SPLIT), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words).cast("long").alias("size"))
    # a source's key is never null
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    rows = stage(rows.withColumns({f"b{i}": _hash(i) for i in range(len(LEVELS))}), "sizes")
    total = rows.count()
    goal = targets(rows).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goal = goal.withColumn("passes", F.least("passes", F.lit(MOST)).cast("long")).withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
    goal = stage(goal, "targets")
    edge, n, lv = goal.select("key", "docs", "budget"), len(LEVELS), range(len(LEVELS))
    light = rows.select("key", "size", *[f"b{k}" for k in lv])
    for i in lv:
        # only rows of the bucket in which the budget ends are counted again
        inside = attach(light, edge, ["key"], "docs", total)
        for k in range(i):
            inside = inside.filter(F.col(f"b{k}") == F.col(f"e{k}"))
        counts = inside.groupBy("key", "budget", f"b{i}").agg(F.sum("size").alias("n"))
        below = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy(f"b{i}").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("below", below).filter("below <= budget")
        last = counts.groupBy("key").agg(F.max_by(F.struct(F.col(f"b{i}").alias("e"), (F.col("budget") - F.col("below")).alias("rest"), "n"), f"b{i}").alias("x"))
        edge = stage(edge.drop("budget", "tail").join(last, "key").select("key", "docs", *[f"e{k}" for k in range(i)], F.col("x.e").alias(f"e{i}"), F.col("x.rest").alias("budget"), F.col("x.n").alias("tail")), "edge", (edge,) if i else ())
    # the last bucket is taken if that ends nearer to the budget
    edge = edge.select("key", *[f"e{k}" for k in lv], (F.col("tail") <= 2 * F.col("budget")).alias("with_edge"))
    out = attach(rows, goal.join(edge, "key", "left").drop("budget"), ["key"], "docs", total)
    here, edge_at = F.struct(*[F.col(f"b{k}") for k in lv]), F.struct(*[F.col(f"e{k}").alias(f"b{k}") for k in lv])
    more = (here < edge_at) | ((here == edge_at) & F.col("with_edge"))
    times = F.col("passes") + F.when(F.coalesce(more, F.lit(False)) & (F.col("passes") < MOST), 1).otherwise(0)
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * times).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("source")


#: The same in one pass of sorting, for small tables: the oracle of op4 and of the pipeline's last stage.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s),
f AS (SELECT *, coalesce(sum(source_size) OVER p, 0)::DOUBLE AS done_size, coalesce(sum(weight) OVER p, 0) AS done_weight, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight
      FROM w WINDOW p AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5::DOUBLE * total - 2 * done_size) / (all_weight - done_weight) AS level FROM f),
t AS (SELECT *, (SELECT arg_min(level, source_size / weight) FROM l WHERE level * weight <= 2 * source_size) AS water FROM l),
g AS (SELECT source, source_size, CASE WHEN total = 0 THEN 0 ELSE least(water * weight, 2 * source_size::DOUBLE) END AS target FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 2) ELSE 0 END AS passes FROM g),
c AS (SELECT source, h, sum(size) AS n FROM d GROUP BY 1, 2),
b AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) - n AS below FROM c),
e AS (SELECT b.*, p.target - p.passes * p.source_size AS budget FROM b JOIN p ON b.source IS NOT DISTINCT FROM p.source),
x AS (SELECT source, max(h) AS h, arg_max(budget - below, h) AS rest, arg_max(n, h) AS n FROM e WHERE below <= budget GROUP BY 1)
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST(d.size * (p.passes + CASE WHEN p.passes < 2 AND (d.h < x.h OR (d.h = x.h AND x.n <= 2 * x.rest)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
