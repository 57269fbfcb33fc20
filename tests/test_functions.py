"""Tables of inputs and expected outputs for single functions and greedy operators."""

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from recallgrid.functions import text as T
from recallgrid.functions import timewin
from recallgrid.operators import rank as R
from recallgrid.operators.lifecycle import chain_ends
from recallgrid.operators.replies import accepted_ops, reconciled
from recallgrid.streaming.episodes import debounce_marks, episode_stream, episodes


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_tokens(spark):
    df = spark.createDataFrame([("What is GRID_SYNC_BATCHES on port 7421? KEY(3) Sub-Q",), ("stopping passed boxes libraries makes made status",), ("",), (None,)], "t string")
    got = [r["x"] for r in df.select(T.tokens("t").alias("x")).collect()]
    assert got[0] == ["grid", "sync", "batch", "port", "7421", "key", "sub"]
    assert got[1] == ["stop", "pass", "box", "library", "make", "status"]
    assert got[2] == [] and got[3] is None


@pytest.mark.parametrize("n,need", [(1, 1), (3, 3), (4, 3), (5, 4), (8, 6)])
def test_required_terms(spark, n, need):
    assert one(spark, R.required_terms(F.lit(n))) == need


def test_same_entity(spark):
    assert one(spark, T.same_entity(F.lit("Atlas v4"), F.lit("atlas"))) is True
    assert one(spark, T.same_entity(F.lit("Atlas"), F.lit("Maps"))) is False
    assert one(spark, T.name_tokens(F.lit("4.6.0"))) == ["4.6.0"]


def test_clauses_and_cut(spark):
    a, b = "a" * 50, "b" * 45
    assert one(spark, T.clauses(F.lit(f"{a}. x; {b}\nend"))) == [f"{a}.", f"x; {b} end"]
    assert one(spark, T.cut_bytes(F.lit("aéb"), 2)) == "a…"
    assert one(spark, T.cut_bytes(F.lit("aé"), 3)) == "aé"


def test_links(spark):
    got = one(spark, T.links(F.lit("m1:related, bad,m2:contrasts,m1:same_series,:x")))
    assert [(x["id"], x["relation"]) for x in got] == [("m1", "related"), ("m2", "contrasts")]


NOW = datetime(2026, 10, 17, 15, tzinfo=timezone(timedelta(hours=8)))  # a Saturday


@pytest.mark.parametrize(
    "phrase,a,b",
    [
        ("on 2026-10-03", "2026-10-03", "2026-10-04"), ("2026-09 notes", "2026-09-01", "2026-10-01"), ("october 3rd", "2026-10-03", "2026-10-04"), ("3 november", "2025-11-03", "2025-11-04"),
        ("yesterday", "2026-10-16", "2026-10-17"), ("5 days ago", "2026-10-12", "2026-10-13"), ("past 2 weeks", "2026-10-03", "2026-10-18"), ("this week", "2026-10-12", "2026-10-18"),
        ("last week", "2026-10-05", "2026-10-12"), ("this month", "2026-10-01", "2026-10-18"), ("last month", "2026-09-01", "2026-10-01"), ("last saturday", "2026-10-10", "2026-10-11"),
        ("in december", "2025-12-01", "2026-01-01"), ("march 2025", "2025-03-01", "2025-04-01"), ("march to victory", None, None), ("2026-13-40", None, None),
    ],
)
def test_time_windows(phrase, a, b):
    got = timewin.parse(phrase, NOW)
    assert got == (None if a is None else tuple(datetime.combine(date.fromisoformat(x), datetime.min.time(), NOW.tzinfo) for x in (a, b)))


def folded_ids(spark, rows, limit, *folds):
    """rows: unit vector, layer, numbers, in their order."""
    from recallgrid.operators.search import folded

    df = spark.createDataFrame([(1, i, i, u, layer, nums) for i, (u, layer, nums) in enumerate(rows)], "query_id int, id int, pos int, u array<double>, layer string, nums array<string>")
    return [r["id"] for r in folded(df, limit, *folds).orderBy("pos").collect()]


def test_mmr(spark):
    from recallgrid.operators.search import spread

    x, y = [1.0, 0.0], [0.0, 1.0]
    fact = lambda u: (u, "l3_fact", [])
    # the second of two equal vectors gives way to another aspect; the first keeps its place
    assert folded_ids(spark, [fact(x), fact(x), fact(y)], 2, spread(0.5)) == [0, 2, 1]
    # other layers and hits without a vector keep their slots
    assert folded_ids(spark, [fact(x), (x, "l8_entity", []), fact(x), fact(None), fact(y)], 3, spread(0.5)) == [0, 1, 4, 3, 2]
    # fewer than three hits, and hits behind the head, stay
    assert folded_ids(spark, [fact(x), fact(x)], 2, spread(0.5)) == [0, 1]
    assert folded_ids(spark, [fact(x), fact(x), fact(x), fact(x), fact(y)], 2, spread(0.5)) == [0, 1, 2, 3, 4]


def test_near_duplicates_last(spark):
    from recallgrid.operators.search import duplicates_last

    x, near, y = [1.0, 0.0], [0.96, 0.28], [0.0, 1.0]
    f = lambda u, *n: (u, "l3_fact", list(n))
    assert folded_ids(spark, [f(x), f(near), f(y), f(x, "7"), f(None), f(x)], 3, duplicates_last(0.95)) == [0, 2, 3, 4, 1, 5]
    # compared with kept hits only, and within the head only
    assert folded_ids(spark, [f(x), f(near), f([0.8432, 0.5376])], 2, duplicates_last(0.95)) == [0, 2, 1]
    assert folded_ids(spark, [f(x), f(y), f(x), f(y)], 1, duplicates_last(0.95)) == [0, 1, 2, 3]


def test_schema_quota(spark):
    """A schema behind the facts found: appended to a short list, else in the place of the last hit that is no page and not the only fact."""
    from recallgrid.operators.search import Rules, Store, with_schema

    def run(layers, limit):
        h = spark.createDataFrame([(1, i, i, x, "o") for i, x in enumerate(layers)], "query_id int, id long, pos int, layer string, owner string")
        ev = spark.createDataFrame([(90, "o", 5, 0), (91, "o", 6, 0), (91, "o", 6, 1), (92, "other", 9, 0)], "id long, owner string, ts int, fact long")
        got = with_schema(h, Store(*[None] * 6, ev), Rules(now="", limit=limit))
        return [r["id"] for r in got.orderBy("pos").collect()]

    assert run(["l3_fact", "l4_summary", "l4_summary"], 3) == [0, 1, 91]
    assert run(["l3_fact", "l3_fact", "l8_entity"], 3) == [0, 91, 2]
    assert run(["l3_fact", "l8_entity"], 2) == [0, 1]
    assert run(["l3_fact", "l6_schema"], 2) == [0, 1]
    assert run(["l3_fact"], 3) == [0, 91]


def test_unit_factor_keeps_order(spark):
    hits = spark.createDataFrame([(1, i, i) for i in range(20)], "query_id int, id int, pos int")
    assert all(r["id"] == r["pos"] for r in R.stage(hits, F.lit(1.0)).collect())


def test_durations():
    from recallgrid.settings import seconds

    assert [seconds(x, 9) for x in ("", None, "off", "0", "90", "15m", "1h30m", "1.5s", "-5", "soon")] == [9, 9, 0, 0, 90, 900, 5400, 1.5, 9, 9]


def test_word_pieces(spark):
    import numpy as np

    from recallgrid.functions.wordpiece import embedder, tokenise

    v = {x: i for i, x in enumerate(["[CLS]", "[SEP]", "[UNK]", "play", "##ing", "ing", "the", "a"])}
    assert tokenise("The playing", v) == [0, 6, 3, 4, 1]
    assert tokenise("zplay", v) == [0, 2, 2, 1]  # "play" inside a word isn't "##play"
    assert tokenise("  ", v)[0] == 0 and len(tokenise("a " * 500, v, 10)) == 10
    got = spark.createDataFrame([("the a",)], "t string").select(embedder(v, np.eye(8, dtype=np.float32))("t").alias("v")).first()["v"]
    assert np.allclose(got, np.array([1, 1, 0, 0, 0, 0, 1, 1]) / 2)


def test_cluster_sync():
    from recallgrid.operators.cluster import sync

    near = {5: [(0.9, 1)], 6: [(0.3, 2)], 7: [(0.95, 1)], 8: []}
    got = sync([(True, [1, 9]), (False, [2, 3])], [1, 2, 3, 5, 6, 7, 8], near, batch=3)
    # 9 is gone; 5 and 7 join their nearest, which is then full; 6 is too far and goes to the time cluster; 8 finds no room
    assert got == [(True, [1, 5, 7]), (False, [2, 3, 6]), (False, [8])]


def test_compacted_turns(spark):
    from recallgrid.functions.turns import NOTHING, compacted

    f = lambda t: one(spark, compacted(F.lit(t), per_message=6, total=100))
    assert f("USER: hello there\n\nTOOL: x\n\nASSISTANT: yes\n\nnot a label") == "USER: hello …\n\nASSISTANT: yes\n\nn…"
    assert f("TOOL: only\n\nSYSTEM: this") == NOTHING and f("no labels at all") == "no labels at all"


def test_relink_and_cycles(spark):
    from recallgrid.operators.lifecycle import relink, without_cycles

    s = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 7)], "id long, superseded_by long")
    gone = spark.createDataFrame([(2,), (5,)], "id long")
    assert {tuple(r) for r in relink(s, gone).select("id", "superseded_by", "how").collect()} == {(1, 3, "replaced"), (4, None, "dropped"), (6, 7, "replaced")}
    p = spark.createDataFrame([("u", 1, 2), ("u", 2, 3), ("u", 3, 1), ("v", 9, 9)], "user_id string, id long, by long")
    assert {tuple(r) for r in without_cycles(p).collect()} == {(1, 2), (2, 3)}


def test_lists_of_hits(spark):
    a = spark.createDataFrame([(1, 10, 0.5, 0), (1, 11, 0.4, 1)], "query_id int, id int, score double, pos int")
    b = spark.createDataFrame([(1, 11, 0.9, 0), (1, 12, 0.1, 1)], a.schema)
    assert [(r["id"], r["score"]) for r in R.merge_best(a, b).orderBy("pos").collect()] == [(11, 0.9), (10, 0.5), (12, 0.1)]
    assert [r["id"] for r in R.append_new(a, b).orderBy("pos").collect()] == [10, 11, 12]
    assert [r["id"] for r in R.place_within(a, b.withColumn("id", F.col("id") + 90), 2).orderBy("pos").collect()] == [10, 101, 11, 102]


def test_quota(spark):
    layers = ["l3_fact", "l2_raw", "l8_entity", "l6_schema"]
    hits = spark.createDataFrame([(1, i, i, x) for i, x in enumerate(layers)], "query_id int, id int, pos int, layer string")
    got = {r["id"]: r["pos"] for r in R.ensure_layer(hits, "l6_schema", 3).collect()}
    assert got == {0: 0, 1: 3, 2: 2, 3: 1}


def test_chain_with_cycle(spark):
    s = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9), (9, 8)], "id long, superseded_by long")
    assert {(r["id"], r["last"]) for r in chain_ends(s, 6).collect()} == {(1, 4), (2, 4), (3, 4)}


def test_replies(spark):
    """Tolerant decoding, ids that were shown only, each id used once in a reply, and what the ops change."""
    import json

    ops = [
        {"op": "link", "fact": "1", "targets": ["10", "99"], "relation": "Related"}, {"op": "UPDATE", "fact": 1, "targets": ["11", "11", "x"], "text": " both "},
        {"op": "SUPERSEDE", "fact": "1", "targets": ["12"]}, {"op": "LINK", "fact": "2", "targets": ["11"], "relation": "related"}, {"op": "SUPERSEDE", "fact": "2", "targets": ["11", "12"]},
        {"op": "SUPERSEDE", "fact": "7", "targets": ["10"]}, {"op": "UPDATE", "fact": "3", "targets": ["10"], "text": " "}, {"op": "LINK", "fact": "3", "targets": ["10"], "relation": "cousin"}, {"op": "ADD", "fact": "3"}, {"op": "SUPERSEDE", "fact": "3"},
    ]
    rows = [(0, "o", "Sure ```" + json.dumps({"ops": ops}) + "``` done", [1, 2, 3], [10, 11, 12]), (1, "o", "no json", [1], [10]), (2, "o", '{"ops": "none"}', [1], [10]), (3, "o", None, [1], [10]), (4, "o", '{"ops":[{"op":"SUPERSEDE","fact":"4","targets":["12","13"],"reason":"old"}]}', [4], [12, 13])]
    got = accepted_ops(spark.createDataFrame(rows, "reply long, owner string, text string, new array<long>, shown array<long>"))
    assert sorted((r["reply"], r["n"], r["op"], r["fact"], r["targets"]) for r in got.collect()) == [(0, 0, "LINK", 1, [10]), (0, 1, "UPDATE", 1, [11]), (0, 4, "SUPERSEDE", 2, [12]), (4, 0, "SUPERSEDE", 4, [12, 13])]
    live = spark.createDataFrame([(1, 5, "decision", ""), (2, 5, "", ""), (4, 5, "", ""), (10, 1, "", ""), (11, 9, "", "2024-01"), (12, 1, "", "")], "id long, ts int, label string, event_at string")
    changed = {(r["change"], r["id"], r["other"], r["how"], r["detail"]) for r in reconciled(live, got).collect()}
    # 13 isn't live any more; 12 is retired once, by the first reply
    assert changed == {
        ("written", -2, None, "2024-01", "decision: both"), ("retired", 1, -2, "updated", ""), ("retired", 11, -2, "updated", ""), ("retired", 12, 2, "replaced", "reason not recorded"),
        ("linked", 1, 10, "related", ""), ("linked", 10, 1, "related", ""),
    }


def test_edges_of_owners(spark):
    """Two owners' edges with the same ends are two; sources go with their edge."""
    from recallgrid.operators.graph import remove_sources, upsert

    cols = "owner string, src string, relation string, dst string, recorded_at long, valid_from long, valid_to long, sources array<long>"
    a = spark.createDataFrame([("u", "a", "r", "b", 5, 5, 5, [1, 2]), ("v", "a", "r", "b", 3, 3, 3, [1]), ("v", "c", "r", "b", 3, 3, 3, [])], cols)
    b = spark.createDataFrame([("u", "a", "r", "b", 2, 2, 9, [2, 3])], cols)
    up = upsert(a, b)
    assert {(r["owner"], r["src"], r["recorded_at"], r["valid_to"], *sorted(r["sources"])) for r in up.collect()} == {("u", "a", 2, 9, 1, 2, 3), ("v", "a", 3, 3, 1), ("v", "c", 3, 3)}
    gone = spark.createDataFrame([(1,), (3,), (3,)], "s long")
    assert {(r["owner"], r["src"], *r["sources"]) for r in remove_sources(up, gone).collect()} == {("u", "a", 2), ("v", "c")}


def test_index_follows_its_input(spark, tmp_path):
    from recallgrid.sources import index

    path = str(tmp_path / "rows.parquet")

    def words():
        rows = lambda: spark.read.parquet(path)
        return {(r["term"], r["tf"]) for r in index.postings(spark, "rows", rows, F.split("t", " "), (path,))[0].collect()}

    spark.createDataFrame([("o", 1, "a b a")], "owner string, id long, t string").write.parquet(path)
    assert words() == words() == {("a", 2), ("b", 1)}
    spark.createDataFrame([("o", 1, "c")], "owner string, id long, t string").write.mode("overwrite").parquet(path)
    assert words() == {("c", 1)}


def test_debounce():
    assert debounce_marks([0, 1, 5, 20, 100], 10) == [0, 10, 20, 100]


def test_stream_equals_batch(spark, sf, tmp_path):
    w = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = w.agg(F.max("ts")).first()[0] + timedelta(days=2)
    w.unionByName(spark.createDataFrame([(-1, last)], w.schema)).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(w.schema).parquet(str(tmp_path / "in"))
    q = episode_stream(s, "6 hours").writeStream.format("memory").queryName("ep").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("ep").collect())) == sorted(map(tuple, episodes(w, "6 hours").collect()))


def test_similar_pairs(spark, monkeypatch):
    """The pivot index gives the pairs of brute force, dealt in blocks or not, with zero, null and short vectors about."""
    import numpy as np

    from recallgrid.operators import cluster

    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    v = [(base[i % 12] * (1 + i % 3) + rng.normal(size=16) * 0.25).tolist() for i in range(240)] + [[0.0] * 16, None, [1.0], [2.0], [None] * 16]
    rows = [(i, f"u{i % 2}", "n" if i % 5 else None, x) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, user_id string, num string, embedding array<double>").repartition(3)
    u = {i: np.pad(np.array(x, float), (0, 16 - len(x))) for i, x in enumerate(v) if x and None not in x and any(x)}
    cos = lambda a, b: round(float(u[a] @ u[b] / np.linalg.norm(u[a]) / np.linalg.norm(u[b])), 6)
    want = {(a, b): cos(a, b) for a in u for b in u if a < b and rows[a][1] == rows[b][1] and cos(a, b) >= 0.8}
    assert len(want) > 500
    for block in (2000, 5):
        monkeypatch.setattr(cluster, "BLOCK", block)
        got = {(r["a"], r["b"]): r["score"] for r in cluster.similar_pairs(df, 0.8).collect()}
        assert got == want
        keyed = {(r["a"], r["b"]) for r in cluster.similar_pairs(df, 0.8, ("user_id", "num")).collect()}
        assert keyed == {(a, b) for a, b in want if rows[a][2] == rows[b][2]}
        asked = cluster.similar_pairs(df, 0.8, new=cluster.F.col("id") % 3 == 0).collect()
        assert len(asked) == len({(r["a"], r["b"]) for r in asked})
        assert {(r["a"], r["b"]): r["score"] for r in asked} == {(a, b): s for (a, b), s in want.items() if a % 3 == 0 or b % 3 == 0}
    assert cluster.similar_pairs(df.limit(0), 0.8).count() == 0


def test_rounds_equal_the_walk(spark):
    """Random edges and lists: rounds decide as one walk from the newest on does."""
    import random

    from recallgrid.operators.cluster import survivors, taken

    rng = random.Random(8)
    e = sorted({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a < b})
    gone: dict[int, int] = {}
    for i in range(60):
        if i not in gone:
            for a, b in e:
                if a == i and b not in gone:
                    gone[b] = i
    got = survivors(spark.createDataFrame([(a, b, a) for a, b in e], "src long, dst long, o long")).collect()
    assert {r["id"]: r["by"] for r in got} == gone
    asks = {i: rng.sample([j for j in range(60) if j != i], rng.randrange(6)) for i in range(60)}
    used: set[int] = set()
    want = set()
    for i in range(60):
        if i not in used:
            members = [i, *[j for j in asks[i] if j not in used][:2]]
            used |= set(members)
            want |= {(i, j) for j in members}
    near = spark.createDataFrame([(i, j, k + 1) for i, x in asks.items() for k, j in enumerate(x)], "seed long, id long, k int")
    assert {tuple(r) for r in taken(near, spark.createDataFrame([(i, i) for i in range(60)], "id long, o long"), 3).collect()} == want


def test_greedy_dedupe_and_clusters(spark):
    from recallgrid.operators.cluster import greedy_clusters, greedy_dedupe

    rows = [(i, "u", datetime(2024, 1, 1 + i), v, ["7"] if i == 5 else []) for i, v in enumerate([[1.0, 0.0], [1.0, 0.05], [0.0, 1.0], [1.0, 0.02], [0.1, 1.0], [1.0, 0.01]])] + [(9, "v", datetime(2024, 1, 9), [1.0, 0.0], [])]
    df = spark.createDataFrame(rows, "id long, user_id string, ts timestamp, embedding array<double>, nums array<string>")
    # the newest has other numbers and replaces nothing
    assert {(r["id"], r["superseded_by"]) for r in greedy_dedupe(df, 0.92).collect()} == {(0, 3), (1, 3), (2, 4)}
    got = {(r["user_id"], r["cluster"], r["topic"], r["id"]) for r in greedy_clusters(df, 0.9, batch=4, small=3).collect()}
    assert got == {("u", 0, True, i) for i in (5, 0, 1, 3)} | {("u", 1, False, i) for i in (2, 4)} | {("v", 0, False, 9)}
    # the last chunk is pulled back: of five rows the chunks of three share one
    df = spark.createDataFrame([(i, "u", datetime(2024, 1, 9 - i), [float(i == j) for j in range(5)]) for i in range(5)], "id long, user_id string, ts timestamp, embedding array<double>")
    got = {(r["cluster"], r["id"]) for r in greedy_clusters(df, batch=3, small=2).collect()}
    assert got == {(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (1, 4)}
