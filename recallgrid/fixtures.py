"""Views over the driver's tables that stand for memory rows, queries, graphs and logs; each as DataFrame and as DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("l1_profile", "l2_raw", "l3_fact", "l4_summary", "l5_knowledge", "l6_schema", "l7_intention", "l8_entity")
#: The clock of every query.
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


LABELS = ("user_preferences", "project_state", "technical_lesson", "decision", "negative_knowledge", "experience", "")


def layer_of(doc_id):
    return F.get(F.array(*map(F.lit, LAYERS)), (F.floor(doc_id / 20) % 8).cast("int"))


def numbered_vectors(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, embedding, n_vectors: the vectors are dealt to rows by id modulo their number."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return v.crossJoin(F.broadcast(v.agg(F.count("*").alias("n_vectors"))))


def with_vectors(rows: DataFrame, spark: SparkSession, d: str, place, name: str = "embedding") -> DataFrame:
    """rows with the vector number place (a column of long) modulo their number."""
    v = numbered_vectors(spark, d)
    n = F.broadcast(v.select("n_vectors").limit(1))
    at = rows.crossJoin(n).withColumn("_v", F.pmod(place, F.col("n_vectors"))).drop("n_vectors")
    return at.join(v.select(F.col("vec_id").alias("_v"), F.col("embedding").alias(name)), "_v").drop("_v")


def mem(spark: SparkSession, d: str, vectors: bool = False, only: DataFrame | None = None, content: Column | None = None) -> DataFrame:
    """Memory rows with whole texts: id, layer, content, user_id, agent_id, ts, session_id, dead, label, event_at, due_at, origin (and embedding).

    Some rows belong to nobody (owner and agent empty); a third of the rows carry an event date, to the day or the month.
    With only (a table with id), just its rows: each table is cut to them before it meets another. content, made of text, stands
    for it: no text is shuffled then.
    """
    docs = table(spark, d, "documents").select("doc_id", (F.col("text") if content is None else content).alias("content"), "lang", "source")
    events = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), "ts", F.col("user_id").alias("session_id"), F.col("event_type").alias("origin"))
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    if only is not None:
        ids = only.select(F.col("id").alias("doc_id")).distinct()
        docs, events, labels = (t.join(ids, "doc_id", "left_semi") for t in (docs, events, labels))
    out = docs.join(events, "doc_id").join(labels, "doc_id", "left")
    if vectors:
        out = with_vectors(out, spark, d, F.col("doc_id"))
    nobody = F.col("doc_id") % 97 == 5
    day = F.date_add(F.col("ts").cast("date"), (F.col("doc_id") % 9).cast("int") - 4)
    event = F.when(F.col("doc_id") % 6 == 0, day.cast("string")).when(F.col("doc_id") % 6 == 1, F.date_format(day, "yyyy-MM")).otherwise("")
    return out.select(
        F.col("doc_id").alias("id"), layer_of(F.col("doc_id")).alias("layer"), "content", F.when(nobody, "").otherwise(F.col("source")).alias("user_id"), F.when(nobody, "").otherwise(F.col("lang")).alias("agent_id"), "ts", "session_id",
        F.when(F.col("toxic") == 1, 1).otherwise(0).alias("dead"), F.get(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 7).cast("int")).alias("label"), event.alias("event_at"), "origin", *(["embedding"] if vectors else []),
    )


def _listed(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def mem_sql(vectors: bool) -> str:
    return (
        f"SELECT d.doc_id AS id, {_listed(LAYERS)}[CAST(floor(d.doc_id / 20) AS BIGINT) % 8 + 1] AS layer, d.text AS content, CASE WHEN d.doc_id % 97 = 5 THEN '' ELSE d.source END AS user_id, CASE WHEN d.doc_id % 97 = 5 THEN '' ELSE d.lang END AS agent_id,"
        f" e.ts, e.user_id AS session_id, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 1 ELSE 0 END AS dead, {_listed(LABELS)}[d.doc_id % 7 + 1] AS label,"
        " CASE d.doc_id % 6 WHEN 0 THEN strftime(e.ts::DATE + CAST(d.doc_id % 9 - 4 AS INTEGER), '%Y-%m-%d') WHEN 1 THEN strftime(e.ts::DATE + CAST(d.doc_id % 9 - 4 AS INTEGER), '%Y-%m') ELSE '' END AS event_at, e.event_type AS origin"
        + (", v.embedding" if vectors else "")
        + " FROM documents d JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id"
        + (" JOIN embeddings v ON v.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)" if vectors else "")
    )


MEM = mem_sql(True)


#: How far a row's vector lies from its topic's: near copies, the same topic, loosely related.
APART = (0.2, 0.5, 1.0)


def topical(spark: SparkSession, d: str) -> DataFrame:
    """mem with vectors of topics: the vector of a topic plus some of the row's own, so that the thresholds of production act (cosines of 0.96 to 0.5 in a topic)."""
    m = mem(spark, d, True).withColumn("_t", F.floor(F.col("id") / 60) % 4 * 7 + 1)
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("_t"), F.col("embedding").alias("_e"))
    w = F.get(F.array(*map(F.lit, APART)), (F.col("id") % 3).cast("int"))
    return m.join(t, "_t").withColumn("embedding", F.zip_with("_e", "embedding", lambda a, b: a.cast("double") + w * b.cast("double"))).drop("_t", "_e")


def topical_named(spark: SparkSession, d: str, content: Column | None = None) -> tuple[DataFrame, DataFrame, dict[int, list[float]]]:
    """Rows of topical that name their vectors (v, t, w), the vectors (v, embedding) and those of topics."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    heads = {r["v"]: r["embedding"] for r in v.filter(F.col("v").isin(*range(1, 23, 7))).collect()}
    w = F.get(F.array(*map(F.lit, APART)), (F.col("id") % 3).cast("int"))
    m = mem(spark, d, content=content).withColumns({"v": F.pmod("id", F.lit(max(1, v.count()))), "t": F.floor(F.col("id") / 60) % 4 * 7 + 1, "w": w})
    return m.filter(F.col("t").isin(*heads)), v, heads


TOPICAL = f"SELECT m.* EXCLUDE (embedding), list_transform(range(1, len(m.embedding) + 1), lambda i: CAST(t.embedding[i] AS DOUBLE) + {list(APART)}[m.id % 3 + 1]::DOUBLE * CAST(m.embedding[i] AS DOUBLE)) AS embedding FROM mem m JOIN embeddings t ON t.vec_id = CAST(floor(m.id / 60) AS BIGINT) % 4 * 7 + 1"


def asked(spark: SparkSession, d: str, words: int = 3) -> DataFrame:
    """Queries, one of each benchmark item: query_id, query (its first short words), owner, q_embedding."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.filter(F.split("text", " "), lambda w: F.length(w).between(3, 5)), 1, words), " ").alias("query"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("owner"))
    return with_vectors(q, spark, d, F.col("query_id"), "q_embedding")


ASKED = "SELECT item_id AS query_id, array_to_string(list_slice(list_filter(string_split(text, ' '), lambda w: length(w) BETWEEN 3 AND 5), 1, 3), ' ') AS query, concat('src', item_id % 20) AS owner, v.embedding AS q_embedding FROM benchmark JOIN embeddings v ON v.vec_id = item_id % (SELECT count(*) FROM embeddings)"


#: Lines of a task where they are dealt by their edges' source.
LINES = 1 << 18


def edges(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """Supplier-part edges with two time axes, in days since 1970 (0: unset); owned by the market of the order's line.

    With dealt, lines are dealt by their edge's source, so that what groups edges by it doesn't shuffle them again.
    """
    li = table(spark, d, "lineitem").withColumn("src", F.concat(F.lit("s"), "l_suppkey"))
    if dealt:
        li = li.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // LINES)), "src")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return li.groupBy("src", F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("relation")).agg(
        F.min(day).cast("long").alias("recorded_at"), F.min(day).cast("long").alias("valid_from"), F.max(day).cast("long").alias("valid_to"),
        F.max(F.when(F.col("l_linestatus") == "F", day + 400).otherwise(0)).cast("long").alias("invalidated_at"),
        F.when(F.min("l_linenumber") == 1, "").otherwise(F.min("l_linestatus")).alias("owner"), F.count("*").alias("n"), F.sort_array(F.collect_set("l_orderkey")).alias("sources"),
    )


_DAY = "date_diff('day', DATE '1970-01-01', l_shipdate::DATE)"
EDGES = (
    f"SELECT concat('s', l_suppkey) AS src, concat('p', l_partkey) AS dst, l_returnflag AS relation, CAST(min({_DAY}) AS BIGINT) AS recorded_at, CAST(min({_DAY}) AS BIGINT) AS valid_from, CAST(max({_DAY}) AS BIGINT) AS valid_to,"
    f" CAST(max(CASE WHEN l_linestatus = 'F' THEN {_DAY} + 400 ELSE 0 END) AS BIGINT) AS invalidated_at, CASE WHEN min(l_linenumber) = 1 THEN '' ELSE min(l_linestatus) END AS owner,"
    " count(*) AS n, list_sort(list_distinct(list(l_orderkey))) AS sources FROM lineitem GROUP BY 1, 2, 3"
)


def retired(spark: SparkSession, d: str) -> DataFrame:
    """Older rows of equal text (in an owner), replaced by the next newer one: id, superseded_by."""
    from pyspark.sql import Window

    m = mem(spark, d)
    w = Window.partitionBy("user_id", F.lower(F.trim("content"))).orderBy("ts", "id")
    return m.select("id", F.lead("id").over(w).alias("superseded_by")).filter("superseded_by is not null")


RETIRED = "SELECT id, superseded_by FROM (SELECT id, lead(id) OVER (PARTITION BY user_id, lower(trim(content)) ORDER BY ts, id) AS superseded_by FROM mem) WHERE superseded_by IS NOT NULL"


def with_views(*names: str, sql: str) -> str:
    """sql with the named views in front."""
    views = {"mem": MEM, "topical": TOPICAL, "asked": ASKED, "edges": EDGES, "retired": RETIRED}
    need = reduce(lambda a, n: [*a, *(["mem"] if n in ("retired", "topical") and "mem" not in a else []), *([n] if n not in a else [])], names, [])
    return "WITH " + ", ".join(f"{n} AS ({views[n]})" for n in need) + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")
