"""Hard negatives by vantage-point trees over norm-augmented vectors.

With one more component, the root of (greatest squared norm - own squared norm), all rows lie on one sphere, and an
anchor's inner product falls as its distance grows: a window of scores is an annulus of distances.
A coarse tree, of vantage points from a bounded sample, deals every row to a cell; a cell's rows lie in
pieces of bounded size, each with a tree of its own made where it is searched. A want (the first k
rows of a window of scores whose label is, or isn't, the anchor's) goes nearest first: to the cell that can hold
the highest score inside its window, then, with the k-th score found there, to all cells that can still
better it. In a piece the leaves are taken in the same order until the next one can't better the k-th row.
Bounds only leave out what can't be in the result, so the result is exact. Wants are rows: they are dealt to
pieces by joins, and neither they nor the rows are broadcast or gathered.

Scores are integers: exact in float64 while squared norms are below 2^52, else in int64.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; shorter
vectors are padded with zeros; components beyond 2^27 in size count as that; a null vec_id comes
last in ties and is no anchor; rows with one vec_id are rows of their own, each an anchor where the id is; fewer rows
than asked give all; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.llm.blocks import Columns, dense, matrix, meet, packed
from recallgrid.llm.common import stage

POSITIVES, NEGATIVES = 5, 10
#: Rows from which the coarse tree takes its vantage points, its cells, rows of a piece and of a leaf.
SAMPLE, CELLS, PIECE, LEAF = 8192, 256, 16384, 256
LARGEST = 1 << 27
#: Component, label and window of the contract's query.
FACTOR, SHIFTED, LOW, HIGH = 256, 7, 30, 90


class Sphere:
    """Distances between augmented rows and anchors; top is the greatest squared norm."""

    def __init__(self, top: int) -> None:
        self.top, self.slack = float(top), 1e-9 * (top + 1)
        self.exact = np.float64 if top < 1 << 52 else np.int64

    def scores(self, a: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (a.astype(self.exact) @ x.astype(self.exact).T).astype(np.int64)

    def norms(self, x: np.ndarray) -> np.ndarray:
        f = x.astype(np.float64)
        return (f * f).sum(axis=1)

    def of_rows(self, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        """From vantage points v to rows x."""
        extra = lambda m: np.sqrt(np.maximum(self.top - self.norms(m), 0))
        d2 = 2 * self.top - 2 * (v.astype(np.float64) @ x.astype(np.float64).T + np.outer(extra(v), extra(x)))
        return np.sqrt(np.maximum(d2, 0))

    def of_anchors(self, v: np.ndarray, a: np.ndarray) -> np.ndarray:
        """From vantage points v to anchors a, whose own extra component is 0."""
        d2 = self.top + self.norms(a)[None] - 2 * (v.astype(np.float64) @ a.astype(np.float64).T)
        return np.sqrt(np.maximum(d2, 0))

    def score_at(self, d: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """The score of a row at distance d from an anchor of a squared norm."""
        return (self.top + norms - d * d) / 2


class Tree:
    """Vantage points, and of each leaf the range of distances to those on its path."""

    def __init__(self, sphere: Sphere, x: np.ndarray, leaf: int, cells: int | None = None) -> None:
        """Splits at the median distance until leaves hold no more than leaf rows (or there are so many cells)."""
        self.sphere, self.leaves, self.cuts = sphere, [], []
        self.points = np.zeros((0, x.shape[1]), x.dtype)
        points: list[np.ndarray] = []
        rng = np.random.default_rng(13)
        depth = None if cells is None else max(0, cells.bit_length() - 1)

        def split(rows: np.ndarray, path: list[tuple[int, float, float]], level: int) -> None:
            if len(rows) <= (1 if depth is not None else leaf) or level == depth:
                self._leaf(rows, path)
                return
            v = x[rows[rng.integers(len(rows))]]
            d = sphere.of_rows(v[None], x[rows])[0]
            cut = float(np.median(d))
            near = d <= cut
            if near.all():  # all at one distance, as copies are
                self._leaf(rows, [*path, (len(points), float(d.min()), float(d.max()))])
                points.append(v)
                return
            p = len(points)
            points.append(v)
            self.cuts.append((p, cut, [b for b in path]))
            split(rows[near], [*path, (p, -np.inf if depth is not None else float(d[near].min()), cut)], level + 1)
            split(rows[~near], [*path, (p, cut if depth is not None else float(d[~near].min()), np.inf if depth is not None else float(d.max()))], level + 1)

        if len(x):
            split(np.arange(len(x)), [], 0)
        if points:
            self.points = np.stack(points)
        self._pack()

    def _leaf(self, rows: np.ndarray, path: list[tuple[int, float, float]]) -> None:
        self.leaves.append((rows, path))

    def _pack(self) -> None:
        n = max([0, *(len(p) for _, p in self.leaves)])
        self.at = np.zeros((len(self.leaves), n), np.int64)
        self.low, self.high = np.full((len(self.leaves), n), -np.inf), np.full((len(self.leaves), n), np.inf)
        for k, (_, path) in enumerate(self.leaves):
            for j, (p, lo, hi) in enumerate(path):
                self.at[k, j], self.low[k, j], self.high[k, j] = p, lo, hi

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf whose ranges each row lies in."""
        d = self.sphere.of_rows(self.points, x) if len(self.points) else np.zeros((0, len(x)))
        out = np.zeros(len(x), np.int64)
        for k in range(len(self.leaves)):
            inside = np.ones(len(x), bool)
            for p, lo, hi in zip(self.at[k], self.low[k], self.high[k]):
                if lo > -np.inf:
                    inside &= d[p] > lo
                if hi < np.inf:
                    inside &= d[p] <= hi
            out[inside] = k
        return out

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, leaves): the least and the greatest score that a row of each leaf can have."""
        s, n = self.sphere, self.sphere.norms(a)
        lo, hi = np.zeros((len(a), len(self.leaves))), np.full((len(a), len(self.leaves)), np.inf)
        if len(self.points):
            d = s.of_anchors(self.points, a)
            for k in range(len(self.leaves)):
                for p, near, far in zip(self.at[k], self.low[k], self.high[k]):
                    if near > -np.inf or far < np.inf:
                        lo[:, k] = np.maximum(lo[:, k], np.maximum(near - d[p], d[p] - far))
                        hi[:, k] = np.minimum(hi[:, k], d[p] + far)
        # an anchor is within (root of top + its norm) of any row
        hi = np.minimum(hi, (np.sqrt(s.top) + np.sqrt(n))[:, None])
        slack = s.slack + 1e-9 * n[:, None]
        return s.score_at(hi, n[:, None]) - slack, s.score_at(lo, n[:, None]) + slack


def search(sphere: Sphere, k_most: int) -> Callable[[Columns], Callable[[Columns], list[Columns]] | None]:
    """The first k rows of each want in a piece; see meet()."""

    def build(index: Columns) -> Callable[[Columns], list[Columns]]:
        x = index["v"]
        tree = Tree(sphere, x, LEAF)
        parts = [(rows, x[rows].astype(sphere.exact)) for rows, _ in tree.leaves]

        def ask(q: Columns) -> list[Columns]:
            out = []
            for at in range(0, len(q["row"]), 512):
                out += one({c: v[at : at + 512] for c, v in q.items()})
            return out

        def one(q: Columns) -> list[Columns]:
            n, a = len(q["row"]), q["v"].astype(sphere.exact)
            least, most = tree.bounds(q["v"])
            fits = (most >= q["low"][:, None]) & (least <= q["high"][:, None])
            # what a leaf can give at best: no more than the window's end
            best = np.where(fits, np.minimum(most, q["high"][:, None].astype(np.float64)), -np.inf)
            order = np.argsort(-best, axis=1, kind="stable")
            score, who = np.full((n, k_most), np.iinfo(np.int64).min), np.full((n, k_most), -1)
            keys = index["vec_id"]
            live = np.arange(n)
            for turn in range(len(parts)):
                leaf = order[live, turn]
                # a leaf whose best is the k-th score may hold a smaller vec_id
                going = (best[live, leaf] > -np.inf) & (best[live, leaf] >= score[live, -1])
                live, leaf = live[going], leaf[going]
                if not len(live):
                    break
                by = np.argsort(leaf, kind="stable")
                cut = np.flatnonzero(np.diff(leaf[by], prepend=-1))
                for s, e in zip(cut, np.append(cut[1:], len(by))):
                    w = live[by[s:e]]
                    rows, xs = parts[leaf[by[s]]]
                    got = (a[w] @ xs.T).astype(np.int64)
                    same = index["label"][rows][None] == q["label"][w][:, None]
                    ok = (got >= np.maximum(q["low"][w], score[w, -1])[:, None]) & (got <= q["high"][w][:, None]) & (same == q["same"][w][:, None]) & (index["row"][rows][None] != q["row"][w][:, None])
                    i, j = np.nonzero(ok)
                    if not len(i):
                        continue
                    # with what is held, ordered by want, score and vec_id; the first k of each want stay
                    held = np.nonzero(who[w] >= 0)
                    wi = np.concatenate((i, held[0]))
                    sc = np.concatenate((got[i, j], score[w][held]))
                    r = np.concatenate((rows[j], who[w][held]))
                    o = np.lexsort((keys[r], -sc, wi))
                    wi, sc, r = wi[o], sc[o], r[o]
                    place = np.arange(len(wi)) - np.searchsorted(wi, wi)
                    keep = place < q["k"][w][wi]
                    touched = w[np.unique(wi)]
                    score[touched], who[touched] = np.iinfo(np.int64).min, -1
                    score[w[wi[keep]], place[keep]], who[w[wi[keep]], place[keep]] = sc[keep], r[keep]
                    # a want of fewer than k_most: its k-th stands last
            i, j = np.nonzero(who >= 0)
            if not len(i):
                return []
            return [{"want": q["want"][i], "row": index["row"][who[i, j]], "vec_id": keys[who[i, j]], "score": score[i, j]}]

        return ask

    return build


#: Instead of null in tasks, behind all ids.
NO_ID = (1 << 63) - 1


def first_rows(wants: DataFrame, pieces: DataFrame, sizes: DataFrame, coarse: Tree, sphere: Sphere, k: int) -> DataFrame:
    """want, row, vec_id, score and place (from 1): the first k rows of each want (want, row, label, same, low, high, v).

    pieces: cell, piece, row, vec_id, label, v. sizes: pieces of each cell.
    """
    wanted = stage(wants, "wants")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of each want that can hold rows of its window, with what they can give, the best one first."""
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                a = matrix(s.column("v"), "i4")
                low, high = (s.column(c).to_numpy() for c in ("low", "high"))
                least, most = coarse.bounds(a)
                fits = (most >= low[:, None]) & (least <= high[:, None])
                best = np.where(fits, np.minimum(most, high[:, None].astype(np.float64)), -np.inf)
                i, j = np.nonzero(fits)
                first = np.zeros(fits.shape, bool)
                first[np.arange(len(a)), best.argmax(axis=1)] = True
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(best[i, j]), pa.array(first[i, j]), *(s.column(c).take(take) for c in names)], ["cell", "best", "first", *names])

    names = ["want", "row", "label", "same", "low", "high", "v"]
    asked = wanted.select(*names).mapInArrow(reach, "cell int, best double, first boolean, want long, row long, label int, same boolean, low long, high long, v binary")

    def found(q: DataFrame) -> DataFrame:
        # one row for each piece of the cell
        dealt = q.join(F.broadcast(sizes), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        index = pieces.select("cell", "piece", F.lit(0).alias("role"), "row", "vec_id", "label", "v", F.lit(0).cast("long").alias("want"), F.lit(False).alias("same"), *[F.lit(0).cast("long").alias(c) for c in ("low", "high", "k")])
        asking = dealt.select("cell", "piece", F.lit(1).alias("role"), "row", F.lit(0).cast("long").alias("vec_id"), "label", "v", "want", "same", "low", "high", F.lit(k).cast("long").alias("k"))
        return meet(index.unionByName(asking), ["cell", "piece"], {"v": "i4"}, search(sphere, k), "want long, row long, vec_id long, score long", alone=True)

    order = Window.partitionBy("want").orderBy(F.desc("score"), "vec_id", "row")
    top = lambda df: df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    near = stage(top(found(asked.filter("first"))).drop("place"), "near")
    reached = near.groupBy("want").agg(F.min("score").alias("kth"), F.count("*").alias("had"))
    more = asked.filter("not first").join(reached, "want", "left").filter(F.expr(f"had is null or had < {k} or best >= kth")).drop("kth", "had")
    return top(near.unionByName(found(more)))


def hard_negatives(vectors: DataFrame, anchor: str = "vec_id % 100 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, factor: int = FACTOR) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and labels, for rows (vec_id, label, embedding).

    anchor is a condition on vec_id. A positive is one of an anchor's first rows of its label; its negatives are
    the first of other labels with low * positive_score <= 100 * score <= high * positive_score.
    """
    dims = max(1, vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, whole = dense(b.column("embedding"), dims)
            v = np.clip(np.floor(m * factor), -LARGEST, LARGEST).astype(np.int32)
            norm = (v.astype(np.int64) ** 2).sum(axis=1)
            keep = pa.array(np.flatnonzero(whole))
            yield pa.RecordBatch.from_arrays([b.column("row").take(keep), b.column("vec_id").take(keep), b.column("label").take(keep), pa.array(norm[whole]), packed(v[whole])], ["row", "vec_id", "label", "norm", "v"])

    rows = vectors.filter("label is not null and embedding is not null").select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    rows = stage(rows.mapInArrow(to_bytes, "row long, vec_id long, label int, norm long, v binary"), "integers")
    total, most = rows.agg(F.count("*"), F.max("norm")).first()
    sphere = Sphere(most or 0)
    # the sample: the rows with the least hashes; fewer than SAMPLE of them whatever the table's size
    sample = rows.select("v", F.xxhash64("row").alias("h")).orderBy("h").limit(SAMPLE).collect() if total else []
    points = np.stack([np.frombuffer(r["v"], np.int32) for r in sample]) if sample else np.zeros((0, dims), np.int32)
    coarse = Tree(sphere, points, PIECE, min(CELLS, 1 << max(0, total // PIECE).bit_length()))

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([pa.array(coarse.assign(matrix(s.column("v"), "i4")).astype(np.int32)), *(s.column(c) for c in ("row", "vec_id", "label", "v"))], ["cell", "row", "vec_id", "label", "v"])

    celled = stage(rows.select("row", "vec_id", "label", "v").mapInArrow(to_cells, "cell int, row long, vec_id long, label int, v binary"), "cells", (rows,))
    # at most CELLS rows
    sizes = stage(celled.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("n")), "sizes")
    pieces = celled.join(F.broadcast(sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("row"), F.col("n")).cast("int")).drop("n")

    anchors = celled.filter(F.col("vec_id") != NO_ID).filter(anchor).select("row", "label", "v", F.col("vec_id").alias("anchor_id"))
    everything = (F.lit(-(1 << 62)), F.lit(1 << 62))
    wants = anchors.select(F.col("row").alias("want"), "row", "label", F.lit(True).alias("same"), everything[0].alias("low"), everything[1].alias("high"), "v")
    firsts = first_rows(wants, pieces, sizes, coarse, sphere, positives)
    pairs = firsts.select(F.col("want").alias("row"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.monotonically_increasing_id().alias("want"))
    pairs = stage(pairs.join(anchors, "row").withColumns({"low": F.expr(f"cast(ceil({low} * cast(positive_score as decimal(38,0)) / 100) as long)"), "high": F.expr(f"cast(floor({high} * cast(positive_score as decimal(38,0)) / 100) as long)")}), "pairs")
    wants = pairs.filter("low <= high").select("want", "row", "label", F.lit(False).alias("same"), "low", "high", "v")
    negative = first_rows(wants, pieces, sizes, coarse, sphere, negatives).select("want", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = pairs.select("want", "anchor_id", "positive_id", "positive_score").join(negative, "want")
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select("anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    shifted = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e.select("vec_id", shifted.alias("label"), "embedding"))


OP13_SQL = """
WITH rows_ AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM rows_ a, rows_ b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), negatives AS (
  SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT * FROM negatives WHERE rank <= 10
"""
