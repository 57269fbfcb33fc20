"""Ranking operators. A query set flows through as rows (query_id, id, pos, ...), pos from 0 within query_id.

Each operator ends with a new pos; no operator multiplies the weights of another. Everything is one
window over query_id, whose partitions are as long as a candidate list, not as the store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.operators.nearest import nearest

RRF_K = 60


def renumber(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "id")) - 1)


def stage(df: DataFrame, factor: Column) -> DataFrame:
    """Positions anew by position weight 1 / (60 + pos + 1) times a factor."""
    w = df.withColumn("_w", F.lit(1.0) / (RRF_K + F.col("pos") + 1) * factor)
    return w.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_w"), "pos")) - 1).drop("_w")


def scoped(queries: DataFrame) -> DataFrame:
    """queries with a row for each owner whose rows they see: their own, and nobody's."""
    return queries.withColumn("scope", F.explode(F.array_distinct(F.array("owner", F.lit("")))))


def vector_top(queries: DataFrame, rows: DataFrame, k: int, same_owner: bool = True) -> DataFrame:
    """query_id, id, score, pos: the k rows of each query by cosine. Exact.

    With an owner a query sees its own rows and those of nobody, without all of them; blocks of rows meet parts of the queries
    (operators/nearest.py), and the lists of a query's scopes are one.
    """
    q = queries.select(F.col("query_id").alias("id"), "owner", F.col("q_embedding").alias("embedding"))
    q = scoped(q).select("id", F.col("scope").alias("user_id"), "embedding") if same_owner else q
    near = nearest(q, rows.select("id", "user_id", "embedding"), k, ("user_id",) if same_owner else (), own=True)
    return near.select(F.col("x").alias("query_id"), F.col("y").alias("id"), "score", (F.col("k") - 1).alias("pos"))


def required_terms(n: Column) -> Column:
    """All of up to three query terms, three quarters (rounded up) of more."""
    return F.when(n <= 3, n).otherwise(F.ceil(n * 0.75)).cast("int")


def bm25(terms: DataFrame, postings: DataFrame, sizes: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, kscore, kpos. terms: query_id, owner, term (distinct); postings: owner, term, id, tf, dl; sizes: owner, n, total.

    A query's scope is its owner's rows and nobody's. Only asked terms are read, once to count the rows of the scope that hold
    them and once to score; the number and mean length of the scope's rows come from sizes, a row an owner.
    """
    need = terms.groupBy("query_id").agg(required_terms(F.count("*")).alias("need"))
    scope = scoped(terms.select("query_id", "owner").distinct()).join(sizes.withColumnRenamed("owner", "scope"), "scope")
    scope = scope.groupBy("query_id").agg(F.sum("n").alias("N"), (F.sum("total") / F.sum("n")).alias("avgdl"))
    asked, held = scoped(terms), postings.withColumnRenamed("owner", "scope")
    # counted where the postings lie: no row of a term is shuffled for it
    df = held.join(asked.select("scope", "term").distinct(), ["scope", "term"], "left_semi").groupBy("scope", "term").agg(F.count("*").alias("n"))
    df = asked.join(df, ["scope", "term"]).groupBy("query_id", "term").agg(F.sum("n").alias("df"))
    hit = asked.join(held, ["scope", "term"]).join(F.broadcast(df), ["query_id", "term"]).join(F.broadcast(scope), "query_id")
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    avg = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avg))
    sums = hit.groupBy("query_id", "id").agg(F.sum(part).alias("s"), F.count("*").alias("m")).join(F.broadcast(need), "query_id").filter("m >= need")
    sums = sums.select("query_id", "id", F.round("s", 9).alias("kscore"))
    # the number itself is compared, so that each task passes on no more than k rows of a query
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("kscore"), "id"))
    return sums.withColumn("n", n).filter(F.col("n") <= k).select("query_id", "id", "kscore", (F.col("n") - 1).alias("kpos"))


def fuse(vector: DataFrame, keyword: DataFrame, floor: float) -> DataFrame:
    """Reciprocal ranks of both lists with the weights wv and wk of the query; vector hits below the floor have no rank. Ties by cosine, then id."""
    ranked = vector.withColumn("vr", F.when(F.col("score").cast("float").cast("double") >= floor, F.col("pos")))
    ranked = ranked.withColumn("vr", F.when(F.col("vr").isNotNull(), F.row_number().over(Window.partitionBy("query_id", F.col("vr").isNotNull()).orderBy("pos")) - 1))
    both = ranked.select("query_id", "id", "score", "vr", "wv").join(keyword.select("query_id", "id", "kpos", "wk"), ["query_id", "id"], "full")
    rrf = F.coalesce(F.col("wv") / (RRF_K + F.col("vr") + 1), F.lit(0.0)) + F.coalesce(F.col("wk") / (RRF_K + F.col("kpos") + 1), F.lit(0.0))
    both = both.withColumn("rrf", F.round(rrf, 12)).filter("vr is not null or kpos is not null").drop("wv", "wk")
    return renumber(both, F.desc("rrf"), F.desc(F.coalesce("score", F.lit(0.0))))


def text_dedupe(hits: DataFrame) -> DataFrame:
    """Of equal texts (lower case, white space collapsed) one stays, at the first one's place; a profile row goes before others."""
    key = F.lower(F.trim(F.regexp_replace("content", "\\s+", " ")))
    w = Window.partitionBy("query_id", key)
    first = hits.withColumn("pos0", F.min("pos").over(w))
    best = first.withColumn("n", F.row_number().over(w.orderBy(F.when(F.col("layer") == "l1_profile", 0).otherwise(1), "pos")))
    return renumber(best.filter("n = 1").withColumn("pos", F.col("pos0")).drop("pos0", "n"), F.col("pos"))


def layer_cap(hits: DataFrame, layer: str, most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("query_id", "layer").orderBy("pos"))
    return renumber(hits.withColumn("_n", n).filter((F.col("layer") != layer) | (F.col("_n") <= most)).drop("_n"), F.col("pos"))


def recency_factor(age_days: Column, half_life: Column) -> Column:
    """0.92 + 0.08 * 2 ** (-age / half life); 1 for no half life, unknown or future."""
    return F.when(half_life.isNull() | age_days.isNull() | (age_days < 0), 1.0).otherwise(0.92 + 0.08 * F.pow(F.lit(2.0), -age_days / half_life))


def half_life_days(layer: Column) -> Column:
    return F.when(layer.isin("l1_profile", "l6_schema", "l8_entity"), None).when(layer == "l7_intention", 3.0).otherwise(30.0)


def usage_factor(shown: Column, used: Column) -> Column:
    return F.when(F.coalesce(shown, F.lit(0)) < 3, 1.0).otherwise(0.94 + 0.12 * (used + 1) / (shown + 2))


def place_within(visible: DataFrame, extras: DataFrame, limit: int) -> DataFrame:
    """Extras take at most max(1, limit // 3) places at the end of the visible part; those that don't fit follow all hits."""
    room = max(1, limit // 3)
    x = extras.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))
    k = x.groupBy("query_id").agg(F.least(F.count("*"), F.lit(room)).alias("_k"))
    v = visible.join(k, "query_id", "left").withColumn("_k", F.coalesce("_k", F.lit(0)))
    v = v.withColumn("_o", F.when(F.col("pos") < limit - F.col("_k"), 0).otherwise(2)).drop("_k")
    both = v.unionByName(x.withColumn("_o", F.when(F.col("_n") <= room, 1).otherwise(3)).drop("_n"), allowMissingColumns=True)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("_o", "pos", "id")) - 1).drop("_o")


def ensure_layer(hits: DataFrame, layer: str, limit: int) -> DataFrame:
    """If the layer isn't among the first limit hits, its best later hit replaces the last that is no entity and not the only fact."""
    w = Window.partitionBy("query_id")
    top = F.col("pos") < limit
    d = hits.withColumns({
        "_has": F.max(F.when(top & (F.col("layer") == layer), 1).otherwise(0)).over(w),
        "_in": F.min(F.when(~top & (F.col("layer") == layer), F.col("pos"))).over(w),
        "_facts": F.sum(F.when(top & (F.col("layer") == "l3_fact"), 1).otherwise(0)).over(w),
        "_size": F.count("*").over(w),
    })
    d = d.withColumn("_out", F.max(F.when(top & (F.col("layer") != "l8_entity") & ~((F.col("layer") == "l3_fact") & (F.col("_facts") == 1)), F.col("pos"))).over(w))
    swap = (F.col("_has") == 0) & F.col("_in").isNotNull() & F.col("_out").isNotNull()
    at = F.when(swap & (F.col("pos") == F.col("_in")), F.col("_out")).when(swap & (F.col("pos") == F.col("_out")), F.col("_in")).otherwise(F.col("pos"))
    return d.withColumn("pos", at.cast("int")).drop("_has", "_in", "_facts", "_size", "_out")


def merge_best(*lists: DataFrame) -> DataFrame:
    """query_id, id, score, pos: lists of hits by id, each at its best score, best first."""
    both = lists[0].select("query_id", "id", "score")
    for x in lists[1:]:
        both = both.unionByName(x.select("query_id", "id", "score"))
    return renumber(both.groupBy("query_id", "id").agg(F.max("score").alias("score")), F.desc("score"))


def append_new(hits: DataFrame, extra: DataFrame) -> DataFrame:
    """Hits of extra (in its order) that aren't there yet follow the others."""
    n = hits.groupBy("query_id").agg(F.max("pos").alias("_last"))
    x = extra.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").join(n, "query_id", "left")
    both = hits.unionByName(x.withColumn("pos", F.col("pos") + F.coalesce("_last", F.lit(-1)) + 1).drop("_last"), allowMissingColumns=True)
    return renumber(both, F.col("pos"))
