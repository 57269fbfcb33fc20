"""Near vectors, fill-in-middle and hard negatives against brute force and SQL, and on awkward rows."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from recallgrid.llm import fim, hard_negatives, near_vectors
from recallgrid.llm.blocks import labels
from recallgrid.llm.queries import QUERIES, SQL

VECTORS = "vec_id long, embedding array<float>, label int, row long, v string, cell int, want long, tab int"


@pytest.mark.parametrize("name", ["op11_near_vectors", "op12_fill_in_middle", "op13_hard_negatives"])
def test_same_rows_as_sql(name, spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got and got == sorted(c.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall(), key=repr)


# --- fill in middle ------------------------------------------------------------------------------


def expected_fim(i, text):
    text = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    spm = h[3] % 100 < 20
    return len(u), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def test_fill_in_middle(spark):
    rng = random.Random(3)
    texts = [None, "", "a", " ", "abc", "é", "aé b", "<P>", "x<S>y", "<M", "<P<S<M>", "P>", "<<P", "S>a<", "a\x85b\0c", "\U0001f600a\U0001f600", "a" * 70_000, " " * 70_000, "ab c\n" * 60_000]
    texts += ["".join(rng.choice("ab Z<>PSM\né\U0001f600.9") for _ in range(rng.randrange(200))) for _ in range(300)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, "again and again", "", 2), (3, "again and again", "", 2), (None, "no id at all, some words", "", 3)]
    made = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(repr, (tuple(r)[1:] for r in fim.restored(made).collect())))
    assert got == sorted(repr(expected_fim(i, t)) for i, t, *_ in rows)
    assert fim.restored(fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


# --- near vectors --------------------------------------------------------------------------------


def brute_links(v, cosine=0.9):
    """Links and least row reachable of each valid vector."""
    ok = [k for k, x in enumerate(v) if x and all(c is not None and math.isfinite(c) for c in x) and any(x)]
    wide = max([1, *(len(v[k]) for k in ok)])
    u = np.array([np.pad(np.array(v[k], np.float32).astype(float), (0, wide - len(v[k]))) for k in ok]).reshape(len(ok), wide)
    u /= np.abs(u).max(axis=1, keepdims=True) if len(u) else 1
    u /= np.linalg.norm(u, axis=1)[:, None] if len(u) else 1
    a, b = np.nonzero(u @ u.T >= cosine)
    n, low = np.zeros(len(v), int), np.arange(len(v))
    np.add.at(n, np.array(ok, int)[a[a != b]], 1)
    if len(ok):
        ids, least = labels(np.array(ok)[a], np.array(ok)[b])
        low[ids] = least
    return n, low


def clusters(rng, n, dims, near):
    base = rng.normal(size=(n, dims))
    more = base[rng.integers(0, n // 10, n)] / np.sqrt(dims)
    out = np.concatenate((base / np.linalg.norm(base, axis=1)[:, None], more + rng.normal(size=more.shape) * near / dims))
    return out.astype(np.float32)


@pytest.mark.parametrize("tiles", [False, True])
def test_near_vectors(spark, monkeypatch, tiles):
    if tiles:  # cells dealt as tiles give the same counts
        monkeypatch.setattr(near_vectors, "BLOCK", 7)
        monkeypatch.setattr(near_vectors, "ASKING", 11)
    rng = np.random.default_rng(4)
    v = [x.tolist() for x in clusters(rng, 400, 64, 1.0)]
    v += [v[0]] * 60 + [[2 * c for c in v[0]], [0.0] * 64, None, [], [None] * 64, [float("nan")] + v[1][1:], v[2][:10], [1e30] * 64, [-0.0] * 63 + [1.0]]
    n, low = brute_links(v)
    rows = [(i, x, 1, 7, "clash", 3, 9, 2) for i, x in enumerate(v)]
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()}
    assert sorted(got) == list(range(len(v)))
    assert [got[i]["n_links"] for i in got] == [n[i] for i in got]
    assert [got[i]["component_id"] for i in got] == [low[i] for i in got]
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_near_vectors_recall(spark):
    """At the threshold itself, in 64 and in 24 dimensions, over nine of ten links are found, and none below it."""
    for dims in (64, 24):
        rng = np.random.default_rng(dims)
        u = rng.normal(size=(1500, dims))
        u /= np.linalg.norm(u, axis=1)[:, None]
        w = rng.normal(size=u.shape)
        w -= (w * u).sum(axis=1)[:, None] * u
        w /= np.linalg.norm(w, axis=1)[:, None]
        v = np.concatenate((u, 0.9005 * u + np.sqrt(1 - 0.9005**2) * w)).astype(np.float32)
        n, _ = brute_links([x.tolist() for x in v])
        got = near_vectors.near_vectors(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")).collect()
        assert all(r["n_links"] <= n[r["vec_id"]] for r in got)
        assert sum(r["n_links"] for r in got) >= 0.94 * n.sum()


def test_near_vectors_awkward_ids(spark):
    a, b = [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]
    rows = [(5, a), (5, a), (3, b), (None, b), (None, [0.5] * 8), (9, None), (9, None), (None, None)]
    got = sorted((tuple(r) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    assert got == sorted([(5, 1, 5, True), (5, 1, 5, True), (3, 1, 3, True), (None, 1, 3, False), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True), (None, 0, None, True)], key=repr)
    assert near_vectors.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


# --- hard negatives ------------------------------------------------------------------------------


def brute_negatives(rows):
    ok = []
    for r, (i, x, label) in enumerate(rows):
        if label is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            ok.append((r, i, label, [max(-(1 << 27), min(1 << 27, math.floor(256 * float(np.float32(c))))) for c in x]))
    last = 1 << 70
    out = []
    for r, i, label, x in ok:
        if i is None or i % 100:
            continue
        s = sorted((-sum(p * q for p, q in zip(x, y)), last if j is None else j, q, lab) for q, j, lab, y in ok if q != r)
        for p, pid, _, _ in [z for z in s if z[3] == label][:5]:
            fits = [z for z in s if z[3] != label and 30 * -p <= 100 * -z[0] <= 90 * -p][:10]
            out += [(i, None if pid == last else pid, k + 1, None if j == last else j, -p, -n) for k, (n, j, _, _) in enumerate(fits)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(hard_negatives, "PIECE", 60)
        monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(6)
    v = clusters(rng, 300, 16, 1.5)
    rows = [(i * 5, x.tolist(), i % 4) for i, x in enumerate(v)]
    rows += [(100, rows[1][1], 2), (100, rows[1][1], 3), (None, rows[2][1], 1), (None, rows[2][1], 0), (200, None, 1), (300, rows[3][1], None), (400, [None] * 16, 1), (500, [float("inf")] * 16, 1), (600, [], 1), (700, rows[4][1][:5], 2), (800, [0.0] * 16, 1)]
    rows += [(10_000 + k, rows[7][1], k % 2) for k in range(150)]  # copies: ties by vec_id
    rows += [(6000, [8.0] * 16, 1), (6001, [0.5] * 16, 0), (6002, [2.0] * 16, 2), (6100, [-0.1] * 16, 77)]
    d = spark.createDataFrame([(i, x, label, 1, "clash", 2, 3, 4) for i, x, label in rows], VECTORS).repartition(3)
    got = hard_negatives.hard_negatives(d)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_negatives(rows)


def test_hard_negatives_large_and_none(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [1e7, 5.0], 1), (2, [5e6, 5.0], 2), (3, [9e5, -1.0], 2), (100, [1e6, 1e6], 2), (4, [7e5, 1e6], 1), (5, [6e5, 9e5], 2)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(100, None, None)], "vec_id long, embedding array<float>, label int")).count() == 0
