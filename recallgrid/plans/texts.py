"""Text utilities as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid import fixtures as X
from recallgrid.functions import text as T
from recallgrid.registry import query


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({T.tokens_sql('text')}) AS term FROM documents) GROUP BY 1")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    """X1, X2 over the texts."""
    docs = X.table(spark, d, "documents").select("text")
    return docs.select(F.explode(T.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '([0-9]+)', 1))), ',') AS numbers FROM documents WHERE regexp_matches(text, '[0-9]')")
def digit_sets(spark: SparkSession, d: str) -> DataFrame:
    """X3, U3."""
    docs = X.table(spark, d, "documents").filter(F.col("text").rlike("[0-9]"))
    return docs.select("doc_id", F.array_join(T.digit_runs(F.col("text")), ",").alias("numbers"))


@query("SELECT doc_id, CASE WHEN strlen(t) <= 60 THEN t ELSE concat((SELECT string_agg(c, '' ORDER BY i) FROM (SELECT c, i, sum(strlen(c)) OVER (ORDER BY i) AS n FROM (SELECT unnest(string_split(substr(t, 1, 60), '')) AS c, generate_subscripts(string_split(substr(t, 1, 60), ''), 1) AS i)) WHERE n <= 60), '…') END AS line FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def one_line(spark: SparkSession, d: str) -> DataFrame:
    """A line of at most 60 bytes, cut at a whole character."""
    docs = X.table(spark, d, "documents").select("doc_id", T.one_spaced(F.col("text")).alias("t"))
    return docs.select("doc_id", T.cut_bytes(F.col("t"), 60).alias("line"))


@query()
def clause_rows(spark: SparkSession, d: str) -> DataFrame:
    """The clauses of long facts."""
    m = X.mem(spark, d).filter("dead = 0 and layer = 'l3_fact' and length(content) > 300")
    return m.select("id", T.clauses(F.col("content")).alias("c")).filter("size(c) > 1").select("id", F.posexplode("c").alias("n", "clause"))


@query("SELECT item_id, term, CASE WHEN regexp_matches(term, '[0-9_]') THEN true ELSE regexp_matches(regexp_replace(term, '^[.,;:!?\"''()\\[\\]{}]+|[.,;:!?\"''()\\[\\]{}]+$', '', 'g'), '[\\p{L}\\p{Nd}][^\\p{L}\\p{Nd}\\s''’][\\p{L}\\p{Nd}]') END AS is_identifier FROM (SELECT item_id, unnest(string_split(text, ' ')) AS term FROM benchmark)")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """X7, X8."""
    w = X.table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("term"))
    return w.withColumn("is_identifier", T.looks_like_identifier(F.col("term")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-01-01' + CAST(c_custkey % 300 AS INTEGER) WHEN c_custkey % 3 = 1 THEN DATE '2024-03-01' END AS event_from, CASE WHEN c_custkey % 3 = 0 THEN DATE '2024-01-01' + CAST(c_custkey % 300 + 1 AS INTEGER) WHEN c_custkey % 3 = 1 THEN DATE '2024-04-01' END AS event_to FROM customer")
def event_spans(spark: SparkSession, d: str) -> DataFrame:
    """X16, X17."""
    c = X.table(spark, d, "customer").select("c_custkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")).cast("string")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(day, F.lit("T10:00"))).when(F.col("c_custkey") % 3 == 1, "2024-03").otherwise("2024-13-45")
    a, b = T.event_span(text)
    return c.select("c_custkey", a.alias("event_from"), b.alias("event_to"))


@query()
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    """X6."""
    from recallgrid.functions.vector import hash_embed

    return X.table(spark, d, "benchmark").select("item_id", hash_embed(64)("text").alias("v"))
