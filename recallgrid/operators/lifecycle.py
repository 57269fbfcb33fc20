"""Row lifecycle: superseding, restoring, relinking, forgetting and decay, as joins that yield new versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def supersede(rows: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """rows with invalid_at, superseded_by, how and reason for live targets of decisions(id, superseded_by, how, reason).

    A decision without a successor is a drop and always has a reason; of several for a row the first by successor counts.
    """
    one = decisions.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.col("superseded_by").asc_nulls_last()))).filter("_n = 1").drop("_n")
    how = F.coalesce("how", F.when(F.col("superseded_by").isNull(), "dropped").otherwise("replaced"))
    reason = F.when(F.col("superseded_by").isNull(), F.coalesce("reason", F.lit("no reason given"))).otherwise(F.col("reason"))
    d = one.select("id", F.lit(True).alias("_hit"), F.col("superseded_by").alias("_by"), how.alias("_how"), reason.alias("_why"))
    out = rows.join(d, "id", "left")
    hit = F.coalesce(F.col("_hit") & F.col("invalid_at").isNull(), F.lit(False))
    return out.select(*[c for c in rows.columns if c not in ("invalid_at", "superseded_by", "how", "reason")], F.when(hit, now).otherwise(F.col("invalid_at")).alias("invalid_at"), *[F.when(hit, F.col(s)).otherwise(F.col(c)).alias(c) for c, s in (("superseded_by", "_by"), ("how", "_how"), ("reason", "_why"))])


def restore(rows: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Superseded rows of ids without the marks, and restored_at."""
    r = rows.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & F.col("invalid_at").isNotNull()
    marks = {c: F.when(hit, None).otherwise(F.col(c)) for c in ("invalid_at", "superseded_by", "how", "reason")}
    return r.withColumn("restored_at", F.when(hit, F.lit(now))).withColumns(marks).drop("_hit")


def chain_ends(successor: DataFrame, rounds: int = 40) -> DataFrame:
    """id -> last: the end of each chain of (id, superseded_by), by pointer doubling. Ids on a cycle have none.

    Each round doubles the length that is followed, so a chain of a million links takes twenty joins;
    rounds stops only what never ends, a cycle.
    """
    ptr = successor.select("id", F.col("superseded_by").alias("to"))
    saved, last = bool(ptr.sparkSession.sparkContext.getCheckpointDir()), None
    for _ in range(rounds):
        nxt = ptr.select(F.col("id").alias("to"), F.col("to").alias("next"))
        both = ptr.join(nxt, "to", "left")
        both = both.checkpoint() if saved else both.persist()
        if both.filter("next is not null and next <> to and next <> id").isEmpty():
            break
        if last is not None and not saved:
            last.unpersist()
        last = both
        ptr = both.select("id", F.coalesce("next", "to").alias("to"))
    # who still points to a replaced row is on a cycle, or leads to one
    return ptr.join(successor.select(F.col("id").alias("to")), "to", "left_anti").select("id", F.col("to").alias("last"))


def relink(successor: DataFrame, gone: DataFrame) -> DataFrame:
    """id, superseded_by, how of (id, superseded_by) after the rows gone (id) are deleted: who was replaced by one of
    them follows the chain to a row that exists; without one it counts as dropped."""
    g = gone.select(F.col("id").alias("superseded_by"))
    stays = successor.join(gone, "id", "left_anti")
    direct = stays.join(g, "superseded_by", "left_anti").select("id", "superseded_by")
    broken = stays.join(g, "superseded_by", "left_semi")
    # from a deleted row on, only deleted rows are followed
    through = successor.join(gone, "id", "left_semi")
    ends = chain_ends(through).withColumnsRenamed({"id": "superseded_by", "last": "end"})
    end = broken.join(ends, "superseded_by", "left").select("id", F.col("end").alias("superseded_by"))
    end = end.join(gone.select(F.col("id").alias("superseded_by"), F.lit(True).alias("_gone")), "superseded_by", "left")
    end = end.select("id", F.when(F.col("_gone").isNull(), F.col("superseded_by")).alias("superseded_by"))
    return direct.unionByName(end).withColumn("how", F.when(F.col("superseded_by").isNull(), "dropped").otherwise("replaced"))


def without_cycles(plan: DataFrame) -> DataFrame:
    """id, by of plan (user_id, id, by; one row an id), in order of id, but the steps that would close a loop.

    A loop exists only where following by returns to the id; those owners' steps are walked in order, one plan of an owner at a time.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by, out = {}, []
        for x in pdf.sort_values("id").itertuples():
            at, loop = x.by, x.by == x.id
            while not loop and at in by:
                at = by[at]
                loop = at == x.id
            if not loop:
                by[x.id] = x.by
                out.append((x.id, x.by))
        return pd.DataFrame(out, columns=["id", "by"], dtype="int64")

    return plan.select("user_id", "id", "by").groupBy("user_id").applyInPandas(run, "id long, by long")


def forget(rows: DataFrame, raw: DataFrame) -> DataFrame:
    """Ids of the raw rows and of live rows whose sources hold one. rows: id, sources; raw: id."""
    derived = rows.select("id", F.explode("sources").alias("s")).join(raw.select(F.col("id").alias("s")), "s", "left_semi").select("id")
    return raw.select("id").union(derived).distinct()


def decay(raw: DataFrame, cited: DataFrame, before: str) -> DataFrame:
    """Extracted raw rows older than before that nothing cites. cited: id."""
    return raw.filter((F.col("ts") < F.lit(before).cast("timestamp_ntz")) & F.col("extracted")).join(cited.select("id").distinct(), "id", "left_anti")
