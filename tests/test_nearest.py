"""The nearest rows by blocks against brute force, and what follows from them."""

import time

import numpy as np


def test_nearest_equals_brute_force(spark, monkeypatch):
    """Blocks and parts of any size give the first k by rounded score, then id, with ties, copies, zero, null and short vectors about."""
    from recallgrid.operators import nearest as N

    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    v = [base[i % 30].tolist() for i in range(200)] + [[0.0] * 8, None, [1.0], [float("nan")] * 8] + rng.normal(size=(60, 8)).tolist()
    rows = [(i, f"u{i % 2}", x) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, user_id string, embedding array<double>").repartition(3)

    def cos(a, b):
        if not a or not b or len(a) != len(b) or not np.isfinite(a + b).all() or not any(a) or not any(b):
            return 0.0
        return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9)

    def want(k, least, own):
        out = set()
        for i, u, x in rows:
            if i % 3 == 0:
                s = sorted((-cos(x, y), j) for j, w, y in rows if u == w and (own or i != j) and (least is None or cos(x, y) >= least))
                out |= {(i, j, n + 1) for n, (_, j) in enumerate(s[:k])}
        return out

    for block, part, run in ((32768, 32768, 32), (40, 25, 4), (7, 90, 2)):
        monkeypatch.setattr(N, "BLOCK", block), monkeypatch.setattr(N, "PART", part), monkeypatch.setattr(N, "RUN", run)
        for k, least, own in ((5, None, False), (3, 0.4, False), (4, None, True)):
            got = N.nearest(df.filter("id % 3 = 0"), df, k, ("user_id",), least, own=own).collect()
            assert {(r["x"], r["y"], r["k"]) for r in got} == want(k, least, own)


def test_pairs_are_no_rows(spark):
    """No plan of the nearest rows joins queries with rows: their number is no bound any more (100,000 queries were refused)."""
    from pyspark.sql import functions as F

    from recallgrid.operators.rank import vector_top

    q = spark.range(100_001).select(F.col("id").alias("query_id"), F.lit("").alias("owner"), F.array(F.lit(1.0), F.col("id") % 2).cast("array<double>").alias("q_embedding"))
    rows = spark.createDataFrame([(1, "", [1.0, 0.0]), (2, "", [1.0, 1.0])], "id long, user_id string, embedding array<double>")
    got = vector_top(q, rows, 1, same_owner=False)
    assert got.filter("id <> query_id % 2 + 1").count() == 0 and got.count() == 100_001


def test_sync_looks_at_full_clusters_once():
    """New facts without near ones fill the newest time cluster with room; full ones aren't walked again for each of them."""
    from recallgrid.operators.cluster import sync

    start = time.time()
    got = sync([(True, [-1]), (False, [-2])], [-1, -2, *range(12000)], {}, 1)
    assert got == [(True, [-1]), (False, [-2]), *[(False, [i]) for i in range(12000)]]
    assert time.time() - start < 1.5
