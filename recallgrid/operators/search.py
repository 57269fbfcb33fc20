"""A whole search: one list of hits a query, carried with all that its stages need.

What can become a hit (nearest rows and clauses, keyword hits, facts dated in the asked window) is gathered
and joined with its row once; the wide list is stored. Every stage after it is a window over query_id or a fold over
the query's list, so the list is shuffled once, whatever the number of stages. Only links and evidence,
which name rows outside the list, join again, on the first hits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from recallgrid.functions import text as T
from recallgrid.functions.vector import dot, unit
from recallgrid.operators import rank as R
from recallgrid.operators.nearest import nearest


@dataclass(frozen=True)
class Rules:
    """Numbers of a search."""

    now: str
    limit: int = 5
    floor: float = 0.1
    window_scan: int = 500
    graph_most: int = 3
    linked_most: int = 2
    schemas_most: int = 2
    near: float = 0.95
    spread: float = 0.75
    durable: tuple[str, ...] = ("user_preferences", "decision", "technical_lesson", "negative_knowledge")

    @property
    def window_floor(self) -> float:
        return max(self.floor - 0.20, 0.0)

    @property
    def graph_floor(self) -> float:
        return self.floor - 0.10

    @property
    def room(self) -> int:
        return max(1, self.limit // 3)


@dataclass(frozen=True)
class Store:
    """What a search reads. rows: live rows with embedding; clauses: parent, n, user_id, embedding; usage: id, shown, used, last;
    links: id, k, to (in the order of k); evidence: id, owner, ts, fact; texts: id, content, where rows have no content."""

    rows: DataFrame
    postings: DataFrame
    sizes: DataFrame
    clauses: DataFrame
    usage: DataFrame
    links: DataFrame
    evidence: DataFrame
    texts: DataFrame | None = None


def by() -> WindowSpec:
    return Window.partitionBy("query_id")


def place(*order: Column) -> Column:
    return F.row_number().over(by().orderBy(*order, "id")) - 1


def clause_hits(queries: DataFrame, clauses: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: rows by their best clause; rows of nobody have none for others. clauses: parent, n, user_id, embedding.

    The best clauses of the first k rows are among the first k times as many clauses as a row has at most, so blocks of clauses
    meet the queries (operators/nearest.py) and no clause is a row for each query. n tells a row's clauses apart, from 0.
    """
    most = (clauses.agg(F.max("n")).first()[0] or 0) + 1
    q = queries.select(F.col("query_id").alias("id"), F.col("owner").alias("user_id"), F.col("q_embedding").alias("embedding"))
    near = nearest(q, clauses.select((F.col("parent") * most + F.col("n")).alias("id"), "user_id", "embedding"), k * most, ("user_id",), own=True)
    best = near.groupBy(F.col("x").alias("query_id"), F.floor(F.col("y") / most).cast("long").alias("id")).agg(F.max("score").alias("score"))
    return best.withColumn("n", F.row_number().over(by().orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k).drop("n")


def dated(rows: DataFrame) -> DataFrame:
    """rows with rf, rt: the event date, to the day or the month, or else the second that the row was written in."""
    a, b = T.event_span(F.col("event_at"))
    return rows.withColumns({"rf": F.coalesce(a.cast("timestamp_ntz"), F.col("ts")), "rt": F.coalesce(b.cast("timestamp_ntz"), F.col("ts") + F.expr("interval 1 second"))})


def window_facts(queries: DataFrame, rows: DataFrame, r: Rules) -> DataFrame:
    """query_id, id, wscore, wpos: the best facts in a query's window, of the newest ones there."""
    facts = dated(rows.filter("layer = 'l3_fact'")).select("id", F.col("user_id").alias("owner"), "ts", unit(F.col("embedding")).alias("v"), "rf", "rt")
    q = queries.filter("f is not null").select("query_id", "owner", unit(F.col("q_embedding")).alias("q"), "f", "t")
    inside = q.join(facts, "owner").filter("rf < t and rt > f").withColumn("n", F.row_number().over(by().orderBy(F.desc("ts"), F.desc("id")))).filter(F.col("n") <= r.window_scan)
    inside = inside.select("query_id", "id", F.round(dot(F.col("q"), F.col("v")), 9).alias("wscore")).filter(F.col("wscore") >= r.window_floor)
    return inside.withColumn("wpos", place(F.desc("wscore"))).filter(F.col("wpos") < r.limit)


def gathered(queries: DataFrame, s: Store, terms: DataFrame, r: Rules) -> DataFrame:
    """query_id, id, score, vpos, kpos, wscore, wpos of all that can become a hit."""
    best = R.merge_best(R.vector_top(queries, s.rows, 3 * r.limit), clause_hits(queries, s.clauses, 3 * r.limit))
    keyword = R.bm25(terms, s.postings, s.sizes, k=10 * r.limit)
    lists = best.select("query_id", "id", "score", F.col("pos").alias("vpos")).unionByName(keyword.select("query_id", "id", "kpos"), True).unionByName(window_facts(queries, s.rows, r), True)
    return lists.groupBy("query_id", "id").agg(*[F.max(c).alias(c) for c in ("score", "vpos", "kpos", "wscore", "wpos")])


def names_any(tokens: Column, names: Column) -> Column:
    """Whether tokens hold every token of one of the names (arrays of arrays)."""
    return F.coalesce(F.exists(names, lambda x: (F.size(x) > 0) & (F.size(F.array_except(x, tokens)) == 0)), F.lit(False))


def described(found: DataFrame, queries: DataFrame, s: Store) -> DataFrame:
    """found with what the stages need of rows, queries and usage. A found row's text is read once, and only a digest and its numbers go on."""
    ids = found.select("id").distinct()
    rows = dated(s.rows.join(ids, "id", "left_semi"))
    rows = rows if s.texts is None else rows.join(s.texts.join(ids, "id", "left_semi"), "id")
    key = F.md5(F.lower(F.trim(F.regexp_replace("content", "\\s+", " "))))
    rows = rows.select("id", "layer", "user_id", "ts", "label", "event_at", "session_id", "rf", "rt", unit(F.col("embedding")).alias("u"), key.alias("key"), T.digit_runs(F.col("content")).alias("nums"), T.tokens("content").alias("toks"))
    q = queries.select("query_id", "owner", "session", "wv", "wk", "f", "t", "identifiers", "names", "neighbours", unit(F.col("q_embedding")).alias("q"))
    h = found.join(rows, "id").join(q, "query_id").join(s.usage.select("id", "shown", "used", "last"), "id", "left")
    h = h.withColumns({"named": names_any(F.col("toks"), F.col("names")), "near": names_any(F.col("toks"), F.col("neighbours")), "holds": F.size(F.array_except("identifiers", "toks")) == 0})
    return h.drop("toks", "names", "neighbours", "identifiers")


def fused(h: DataFrame, r: Rules) -> DataFrame:
    """h with pos (null: no hit yet): reciprocal ranks, identifiers, one hit of each text, and the window's facts behind them."""
    passed = F.col("score").cast("float").cast("double") >= r.floor
    h = h.withColumn("vr", F.when(passed, F.row_number().over(Window.partitionBy("query_id", F.coalesce(passed, F.lit(False))).orderBy("vpos")) - 1))
    rrf = F.coalesce(F.col("wv") / (R.RRF_K + F.col("vr") + 1), F.lit(0.0)) + F.coalesce(F.col("wk") / (R.RRF_K + F.col("kpos") + 1), F.lit(0.0))
    hit = (F.col("vr").isNotNull() | F.col("kpos").isNotNull()) & F.col("holds")
    h = h.withColumn("rrf", F.when(hit, F.round(rrf, 12)))
    h = h.withColumn("pos0", F.when(hit, place(F.col("rrf").desc_nulls_last(), F.desc(F.coalesce("score", F.lit(0.0))))))
    # of equal texts one stays, at the first one's place; a profile row goes before others
    same = Window.partitionBy("query_id", "key")
    n = F.row_number().over(same.orderBy(F.isnull("pos0"), F.when(F.col("layer") == "l1_profile", 0).otherwise(1), "pos0"))
    h = h.withColumns({"p0": F.min("pos0").over(same), "n": n}).withColumn("p0", F.when(F.col("pos0").isNotNull() & (F.col("n") == 1), F.col("p0")))
    group = F.when(F.col("p0").isNotNull(), 0).when(F.col("wpos").isNotNull(), 1)
    return h.withColumn("g", group).withColumn("pos", F.when(F.col("g").isNotNull(), place(F.col("g").asc_nulls_last(), F.coalesce("p0", "wpos")))).drop("vr", "rrf", "pos0", "p0", "n", "g", "wk", "wv", "holds", "key")


def placed(h: DataFrame, extra: Column, r: Rules) -> DataFrame:
    """Hits and extras (those with a number from 1): extras take the room at the end of the visible part, the others follow all hits."""
    k = F.least(F.max(F.coalesce(extra, F.lit(0))).over(by()), F.lit(r.room))
    h = h.withColumns({"_x": extra, "_k": k})
    part = F.when(F.col("_x").isNull(), F.when(F.col("pos") < r.limit - F.col("_k"), 0).otherwise(2)).when(F.col("_x") <= r.room, 1).otherwise(3)
    return h.withColumn("_o", part).withColumn("pos", place("_o", F.coalesce("_x", "pos"))).drop("_x", "_k", "_o")


def in_context(h: DataFrame, r: Rules) -> DataFrame:
    """Hits outside the asked window sink, those that name an entity rise, and what the graph links to them comes in."""
    listed = F.col("pos").isNotNull()
    weight = lambda factor: F.when(listed, F.lit(1.0) / (R.RRF_K + F.col("pos") + 1) * factor)
    for factor in (F.when(F.col("f").isNotNull() & ~((F.col("rf") < F.col("t")) & (F.col("rt") > F.col("f"))), 0.85).otherwise(1.0), F.when(F.col("named"), 1.06).otherwise(1.0)):
        h = h.withColumn("_w", weight(factor)).withColumn("pos", F.when(listed, F.row_number().over(by().orderBy(F.col("_w").desc_nulls_last(), F.col("pos").asc_nulls_last())) - 1)).drop("_w")
    may = ~listed & F.col("near") & F.col("vpos").isNotNull() & (F.col("score") >= r.graph_floor)
    h = h.withColumn("_may", F.coalesce(may, F.lit(False)))
    h = h.withColumn("_n", F.when(F.col("_may"), F.row_number().over(Window.partitionBy("query_id", "_may").orderBy("vpos")))).filter(listed | (F.col("_n") <= r.graph_most))
    return placed(h, F.col("_n"), r).withColumn("via", F.when(F.col("_n").isNotNull(), "graph").otherwise("")).drop("_may", "_n", "f", "t", "rf", "rt", "named", "near", "vpos", "kpos", "wpos")


def stale(r: Rules) -> Column:
    _, due = T.event_span(F.col("event_at"))
    now = F.lit(r.now).cast("timestamp_ntz")
    old = F.when(due.isNotNull(), now >= due.cast("timestamp_ntz") + F.expr("interval 1 day")).otherwise(F.expr(f"timestampdiff(SECOND, ts, timestamp_ntz'{r.now}') > 7 * 86400"))
    return (F.col("layer") == "l7_intention") & F.coalesce(old, F.lit(False))


def signalled(h: DataFrame, r: Rules) -> DataFrame:
    """Stale intentions go; recency, use and session each move hits from the places that the one before gave."""
    h = h.filter(~stale(r)).withColumn("pos", place("pos"))
    now = F.lit(r.now).cast("timestamp_ntz")
    ref = F.greatest("ts", F.coalesce(F.when(F.col("last") <= now, F.col("last")), F.col("ts")))
    half = F.when((F.col("layer") == "l3_fact") & F.col("label").isin(*r.durable), 180.0).otherwise(R.half_life_days(F.col("layer")))
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ref.cast("timestamp"))) / 86400.0
    session = F.when((F.col("layer") != "l7_intention") | F.col("session").isNull() | F.col("session_id").isNull(), 1.0).when(F.col("session_id") == F.col("session"), 1.08).otherwise(0.95)
    for factor in (R.recency_factor(age, half), R.usage_factor(F.col("shown"), F.col("used")), session):
        h = R.stage(h, factor)
    return h.drop("shown", "used", "last", "session", "session_id", "event_at")


# --- folds over a query's list --------------------------------------------------------------------


def folded(h: DataFrame, limit: int, *folds: Callable[[Column], Column]) -> DataFrame:
    """h in the order that the folds give to the head of 2 * limit of each query's list. The list is one row; h has pos."""
    rest = [c for c in h.columns if c not in ("query_id", "pos")]
    a = h.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("a"))
    head = F.slice("a", 1, 2 * limit)
    for f in folds:
        head = f(head)
        a = a.withColumn("_h", head)
        head = F.col("_h")
    a = a.withColumn("a", F.concat(head, F.slice("a", 2 * limit + 1, 1 << 30))).drop("_h")
    return a.select("query_id", F.posexplode("a").alias("pos", "x")).select("query_id", "pos", *[F.col(f"x.{c}").alias(c) for c in rest])


def duplicates_last(near: float) -> Callable[[Column], Column]:
    """Hits as near as that to one kept before them, with the same numbers, go behind the kept ones. Elements have u (unit vector) and nums."""

    def fold(head: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            again = F.coalesce(F.exists(acc["kept"], lambda k: (k["nums"] == x["nums"]) & (F.round(dot(k["u"], x["u"]), 9) >= near)), F.lit(False))
            return F.struct(F.when(again, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"), F.when(again, F.concat(acc["late"], F.array(x))).otherwise(acc["late"]).alias("late"))

        none = F.slice(head, 1, 0)
        return F.aggregate(head, F.struct(none.alias("kept"), none.alias("late")), step, lambda acc: F.concat(acc["kept"], acc["late"]))

    return fold


SPREAD = ("l2_raw", "l3_fact", "l4_summary", "l5_knowledge")


def spread(weight: float, least: int = 3) -> Callable[[Column], Column]:
    """Maximal marginal relevance among the elements of SPREAD's layers with a vector (layer, u); the others keep their slots."""

    def fold(head: Column) -> Column:
        n = F.size(head)
        first, last = F.lit(1.0 / (R.RRF_K + 1)), F.lit(1.0) / (R.RRF_K + n)
        relevance = lambda i: F.when(n > 1, (F.lit(1.0) / (R.RRF_K + 1 + i) - last) / (first - last)).otherwise(1.0)
        may = lambda x: x["layer"].isin(*SPREAD) & x["u"].isNotNull()
        slots = F.filter(F.transform(head, lambda x, i: F.struct(i.alias("i"), F.when(may(x), x["u"]).alias("u"))), lambda c: c["u"].isNotNull())

        def step(acc: Column, _: Column) -> Column:
            worth = lambda c: F.round(weight * relevance(c["i"]) - (1 - weight) * F.greatest(F.lit(0.0), F.coalesce(F.array_max(F.transform(acc["chosen"], lambda k: dot(k["u"], c["u"]))), F.lit(0.0))), 9)
            best = F.array_max(F.transform(acc["left"], lambda c: F.struct(worth(c).alias("s"), (-c["i"]).alias("o"))))
            # the best is computed once, as the only element of an array
            return F.transform(F.array(-best["o"]), lambda b: F.struct(F.filter(acc["left"], lambda c: c["i"] != b).alias("left"), F.concat(acc["chosen"], F.filter(acc["left"], lambda c: c["i"] == b)).alias("chosen")))[0]

        order = F.aggregate(slots, F.struct(slots.alias("left"), F.slice(slots, 1, 0).alias("chosen")), step, lambda acc: F.transform(acc["chosen"], lambda c: c["i"]))
        # the k-th slot gets the k-th chosen
        moved = lambda o: F.transform(head, lambda x, i: F.when(F.array_contains(o, i), F.get(head, F.get(o, F.size(F.filter(o, lambda j: j < i))))).otherwise(x))
        return F.when(n >= least, F.transform(F.array(order), moved)[0]).otherwise(head)

    return fold


# --- what the first hits bring in -----------------------------------------------------------------


def with_links(h: DataFrame, s: Store, r: Rules) -> DataFrame:
    """Live facts of the owner that the first hits link to, in that order, with their own cosine."""
    top = h.filter((F.col("pos") < r.limit) & (F.col("layer") == "l3_fact")).select("query_id", "pos", "id", "owner", "q")
    to = top.join(s.links, "id").select("query_id", "pos", "k", F.col("to").alias("id"), F.col("owner").alias("user_id"), "q")
    facts = s.rows.filter("layer = 'l3_fact'").select("id", "layer", "label", "user_id", "ts", unit(F.col("embedding")).alias("u"))
    to = to.join(facts, ["id", "user_id"]).join(h.select("query_id", "id"), ["query_id", "id"], "left_anti")
    to = to.withColumn("_d", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("pos", "k"))).filter("_d = 1")
    to = to.withColumn("_n", F.row_number().over(by().orderBy("pos", "k"))).filter(F.col("_n") <= r.linked_most)
    extra = to.select("query_id", "id", "layer", "label", "ts", F.round(dot(F.col("q"), F.col("u")), 9).alias("score"), F.lit("link").alias("via"), F.col("user_id").alias("owner"), F.lit(None).cast("int").alias("pos"), "_n")
    return placed(h.drop("q").withColumn("_n", F.lit(None).cast("int")).unionByName(extra), F.col("_n"), r).drop("_n")


def with_schema(h: DataFrame, s: Store, r: Rules) -> DataFrame:
    """If no schema is among the first hits, the one that cites most of their facts (the newest of equals) gets a place.

    It is appended where the list is short; else it replaces the last hit that is no entity page and not the only fact.
    """
    top = h.filter((F.col("pos") < r.limit) & (F.col("layer") == "l3_fact")).select("query_id", F.col("id").alias("fact"), "owner")
    cited = top.join(s.evidence, ["fact", "owner"]).groupBy("query_id", "id", "ts").agg(F.countDistinct("fact").alias("cites"))
    cited = cited.withColumn("_n", F.row_number().over(by().orderBy(F.desc("cites"), F.desc("ts"), F.desc("id")))).filter(F.col("_n") <= r.schemas_most)
    one = cited.join(h.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id").agg(F.min_by(F.struct("id", "ts"), "_n").alias("x"))
    top_ = F.col("pos") < r.limit
    h = h.withColumns({"_size": F.count("*").over(by()), "_has": F.max((top_ & (F.col("layer") == "l6_schema")).cast("int")).over(by()), "_facts": F.sum((top_ & (F.col("layer") == "l3_fact")).cast("int")).over(by())})
    h = h.withColumn("_out", F.max(F.when(top_ & (F.col("layer") != "l8_entity") & ~((F.col("layer") == "l3_fact") & (F.col("_facts") == 1)), F.col("pos"))).over(by()))
    wants = h.filter("_has = 0").groupBy("query_id").agg(F.max("_size").alias("_size"), F.max("_out").alias("_out"))
    at = F.when(F.col("_size") < r.limit, F.col("_size")).otherwise(F.col("_out"))
    new = one.join(wants, "query_id").withColumn("pos", at.cast("int")).filter("pos is not null").select("query_id", "pos", F.col("x.id").alias("id"), F.lit("l6_schema").alias("layer"), F.col("x.ts").alias("ts"), F.lit("evidence").alias("via"))
    kept = h.drop("_size", "_has", "_facts", "_out").join(new.select("query_id", "pos"), ["query_id", "pos"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def search(queries: DataFrame, terms: DataFrame, s: Store, r: Rules, saved: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """query_id, pos, id, layer, label, score, via: the first hits of each query.

    queries: query_id, query, owner, session, q_embedding, wv, wk, f, t (the asked window, or null), identifiers (tokens that
    hits must hold), names and neighbours (arrays of token arrays). terms: query_id, owner, term. saved() stores a table.
    An intention that ranked behind the cut is on the list already, so its quota changes nothing.
    """
    found = saved(gathered(queries, s, terms, r), "found")
    h = in_context(fused(described(found, queries, s), r), r)
    h = folded(signalled(h, r), r.limit, duplicates_last(r.near), spread(r.spread))
    h = saved(h.withColumn("score", F.coalesce("score", "wscore", F.lit(0.0))).drop("u", "nums", "user_id", "wscore"), "ranked")
    h = with_links(h, s, r)
    for layer, most in (("l5_knowledge", max(1, 2 * r.limit // 5)), ("l8_entity", 2)):
        h = R.layer_cap(h, layer, most)
    h = with_schema(saved(h, "capped"), s, r)
    return h.filter(F.col("pos") < r.limit).select("query_id", "pos", "id", "layer", "label", "score", "via")
