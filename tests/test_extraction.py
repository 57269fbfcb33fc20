"""Replies applied to a store: hand-made cases, and a batch that runs twice."""

import json
import shutil

import pytest

from recallgrid.operators import extraction as E

T0 = "2024-01-01 00:00:00"


def row(i, layer, content, v=None, source=None, label="", extracted=None, gone=None):
    from datetime import datetime

    return (i, layer, content, "u", "", label, datetime.fromisoformat(T0), source, "", "", v, extracted, gone, "dropped" if gone else None)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        row(1, "l2_raw", "said", extracted=False), row(2, "l2_raw", "said more"), row(3, "l2_raw", "done before", extracted=True), row(4, "l2_raw", "no json"), row(5, "l2_raw", None),
        row(10, "l3_fact", "port 80", [1.0, 0.0, 0.0], 90), row(11, "l3_fact", "port 81", [0.0, 1.0, 0.0], 91), row(12, "l3_fact", "tea", [0.0, 0.0, 1.0], 92), row(13, "l3_fact", "old", [1.0, 0.0, 0.0], 93, gone=12),
        row(14, "l3_fact", None, None, None), row(20, "l1_profile", "tea", source=92), row(21, "l1_profile", "tea", source=91), row(30, "l7_intention", "go"), row(31, "l7_intention", "stay"),
    ], E.ROW)


def reply(i, facts=(), goal=None, done=(), vectors=(), shown=(10, 11, 12, 13), text=None):
    body = {"facts": list(facts), "intention": goal, "intentions_done": list(done)}
    return (i, text or f"```json\n{json.dumps(body)}\n```", list(shown), [30], [list(v) for v in vectors])


REPLIES = "reply long, text string, shown array<long>, open array<long>, vectors array<array<double>>"


def changed(spark, rows, replies):
    return {r["id"]: r for r in E.apply(rows, spark.createDataFrame(replies, REPLIES)).collect()}


def test_apply(spark, rows):
    got = changed(spark, rows, [
        reply(1, [{"data": "the port is 80", "layer": "decision", "when": "2024-05-06 10:00", "updates": ["11", "12", "x"], "replaces": [" 12 "]}, {"data": ""}, {"data": "likes tea", "layer": "user_preferences", "when": "2024-05"}],
              {"goal": "ship", "due": "2024-07", "replaces": ["30", "31"]}, ["30"], [[1.0, 0.1, 0.0], [], [0.5, 0.5, 0.5]]),
        reply(2, [{"data": "the port is 80, again", "updates": ["10", "99"]}, {"data": "port 82"}], None, ["30", "31"], [[1.0, 0.1, 0.0], [0.0, 1.0, 0.0]]),
        reply(3, [{"data": "late"}]), reply(4, text="none { of it"), reply(5, text='{"facts": "none", "intention": {"goal": "  "}}'), reply(77, [{"data": "no row"}]),
    ])
    f = lambda r, n: -(r * E.ROOM + 2 * n + 2)
    how = {i: (r["superseded_by"], r["how"]) for i, r in got.items() if r["how"]}
    # 10 is restated by the first fact, that fact by the second reply's; 81 and 82 are different numbers; 12's profile row goes with it
    assert how == {10: (f(1, 0), "restated"), 11: (f(1, 0), "updated"), 12: (f(1, 0), "replaced"), 20: (f(1, 0), "replaced"), f(1, 0): (f(2, 0), "restated"), 30: (-(E.ROOM + 1), "replaced")}
    assert {i for i, r in got.items() if r["layer"] == "l2_raw" and r["extracted"]} == {1, 2, 5}
    assert {(r["layer"], r["content"], r["event_at"], r["due_at"]) for i, r in got.items() if i < 0} == {
        ("l3_fact", "the port is 80", "2024-05-06", ""), ("l3_fact", "likes tea", "", ""), ("l1_profile", "likes tea", "", ""), ("l7_intention", "ship", "", "2024-07"), ("l3_fact", "the port is 80, again", "", ""), ("l3_fact", "port 82", "", ""),
    }


def test_empty(spark, rows):
    assert changed(spark, rows, []) == {} == changed(spark, rows.limit(0), [reply(1, [{"data": "x"}])])
    # a fact without a vector is written and compared with nothing; of two replies to a row one counts
    got = changed(spark, rows, [reply(1, [{"data": "port 80"}]), reply(1, [{"data": "port 80"}])])
    assert sorted(got) == [-(E.ROOM + 2), 1]


def test_batch_again(spark, rows, tmp_path):
    """A batch that is run a second time leaves the versions as they were; the next one sees them."""

    def run(path):
        s = spark.readStream.schema(REPLIES).parquet(str(tmp_path / "in"))
        E.start(rows, s, str(path)).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(str, E.versions(spark, f"{path}/rows").collect()))

    spark.createDataFrame([reply(1, [{"data": "port is 80"}], vectors=[[1.0, 0.0, 0.0]])], REPLIES).write.parquet(str(tmp_path / "in"))
    first = run(tmp_path / "s")
    shutil.rmtree(tmp_path / "s" / "offsets")  # as if the driver had died before it noted the batch
    assert run(tmp_path / "s") == first
    spark.createDataFrame([reply(2, [{"data": "it's 80"}], vectors=[[1.0, 0.0, 0.1]])], REPLIES).write.mode("append").parquet(str(tmp_path / "in"))
    assert len(run(tmp_path / "s")) == len(first) + 2
    by = {r["id"]: r["superseded_by"] for r in E.versions(spark, f"{tmp_path}/s/rows").collect()}
    assert by[10] == -(E.ROOM + 2) and by[-(E.ROOM + 2)] == -(2 * E.ROOM + 2)
