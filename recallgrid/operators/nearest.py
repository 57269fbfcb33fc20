"""The nearest rows of each query by cosine, exact, by blocks of bounded size.

Rows of a group are dealt to blocks and its queries to parts; each block meets each part in one task as matrices, and
keeps the first k of each query. So the pairs are never rows of a table: what is shuffled is rows times parts,
queries times blocks, and k rows for each query and block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallgrid.operators.meeting import Columns, dense, meet, packed

#: Rows of a block and queries of a part (16 MB of 64 dimensions each), scores held at once, and neighbours whose best score bounds the rest.
BLOCK, PART, SCORES, RUN = 32768, 32768, 1 << 21, 32


def first_k(score: np.ndarray, ids: np.ndarray, k: int, least: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, row) of a superset, by ties and rounding only, of each query's k highest scores that reach least."""
    n = score.shape[1]
    floor = np.full(len(score), least)
    if n > k:
        # the best of disjoint runs are so many different rows: the k-th of them is no better than the k-th of all
        runs = -(-n // RUN)
        if runs > k:
            best = np.maximum.reduceat(score, np.arange(0, n, RUN), axis=1)
            floor = np.maximum(floor, np.partition(best, runs - k, axis=1)[:, runs - k])
        else:
            floor = np.maximum(floor, np.partition(score, n - k, axis=1)[:, n - k])
    a, b = np.nonzero(score >= (floor - slack)[:, None])
    order = np.lexsort((ids[b], -np.round(score[a, b] / slack) if slack else -score[a, b], a))
    a, b = a[order], b[order]
    # the place of each in its query
    start = np.searchsorted(a, np.arange(len(score)))
    keep = np.arange(len(a)) - start[a] < k
    return a[keep], b[keep]


def nearest(queries: DataFrame, rows: DataFrame, k: int, by: tuple[str, ...] = (), least: float | None = None, digits: int = 9, own: bool = False) -> DataFrame:
    """x, y, score, k: the first k rows y of each query x that are equal in by, by cosine (of so many digits, then id), k from 1.

    queries and rows: id, embedding and by. A row isn't its own neighbour unless own (queries with ids of their own). With least, only scores that reach it. Null,
    zero or not wholly finite vectors score 0, and so do vectors of different lengths.
    """
    dims = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    slack = 10.0**-digits

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column("embedding")
            sizes = pc.fill_null(pc.list_value_length(column), -1)
            m, ok = dense(column, max(dims, int(pc.max(sizes).as_py())))
            m = m[:, :dims]
            norm = np.sqrt((m**2).sum(axis=1, keepdims=True))
            v = np.divide(m, norm, out=np.zeros_like(m), where=(norm > 0) & ok[:, None])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("g"), b.column("h"), sizes.cast(pa.int32()), packed(v)], ["id", "g", "h", "width", "v"])

    def keyed(df: DataFrame) -> DataFrame:
        key = (F.xxhash64(*by), F.hash(*by).cast("long")) if by else (F.lit(0).cast("long"), F.lit(0).cast("long"))
        return df.select("id", key[0].alias("g"), key[1].alias("h"), "embedding")

    r, q = keyed(rows), keyed(queries)
    shape = "id long, g long, h long, width int, v binary"
    size = r.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(q.groupBy("g").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "g")
    at = F.xxhash64("id")
    dealt = r.mapInArrow(units, shape).join(size, "g").select("g", F.pmod(at, F.col("blocks")).cast("int").alias("blk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "id", "h", "width", "v")
    asked = q.mapInArrow(units, shape).join(size, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), F.pmod(at, F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), "id", "h", "width", "v")

    def compare(index: Columns) -> Callable[[Columns], list[Columns]]:
        ids = index["id"]

        def top(x: Columns) -> list[Columns]:
            out, step = [], max(1, SCORES // len(ids))
            alike = (index["width"] == index["width"][0]).all() and (index["h"] == index["h"][0]).all()
            for s in range(0, len(x["id"]), step):
                e = s + step
                score = x["v"][s:e] @ index["v"].T
                if not alike or (x["width"][s:e] != index["width"][0]).any() or (x["h"][s:e] != index["h"][0]).any():
                    score[x["width"][s:e, None] != index["width"][None]] = 0
                    score[x["h"][s:e, None] != index["h"][None]] = -np.inf
                # the row itself takes a place
                a, b = first_k(score, ids, k if own else k + 1, -2.0 if least is None else least, slack)
                if not own:
                    ok = x["id"][a + s] != ids[b]
                    a, b = a[ok], b[ok]
                if len(a):
                    out.append({"x": x["id"][a + s], "y": ids[b], "score": score[a, b]})
            return out

        return top

    met = meet(dealt.unionByName(asked), ["g", "blk", "part"], {"v": "f8"}, compare, "x long, y long, score double", alone=True)
    met = met.withColumn("score", F.round("score", digits))
    met = met if least is None else met.filter(F.col("score") >= least)
    return met.withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "y"))).filter(F.col("k") <= k)
