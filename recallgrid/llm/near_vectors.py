"""Near copies among vectors by lattice hashing.

Equal vectors are one class. A class's unit vector is projected, by blocks of a random rotation, to eight
dimensions in each of several tables and decoded to the nearest point of the E8 lattice: its cell. A class
lies in its own cell of each table and asks there and in the neighbouring cells (of the 240 around, those
whose points lie nearest to the projection). Whatever meets is compared by cosine in double precision.

What meets in a cell is compared as matrices, and leaves the task as a number of links a class and the least
class reachable, never as pairs: a pair counts where it meets first, by the order of tables, which either
side's own projections tell. Cells with very many classes are dealt as tiles of bounded blocks of the two sides.
Projections are computed in integers, so that each task decodes a vector alike.

Recall: a pair at cosine 0.9 exactly is found with a probability of 0.97 to 0.99 (64 dimensions; one at 0.95, of
over 0.999), whatever the number of rows; see tests/llm. With more rows the same cells hold more; a smaller
scale with more tables or probes has finer cells.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
shorter vectors are padded with zeros; rows with one vec_id, or without one, are vectors of their own; a
component that lacks ids has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm.blocks import Columns, dense, labels, matrix, meet, packed
from recallgrid.llm.common import attach, components, numbered, stage

COSINE, TABLES, PROBES = 0.9, 6, 6
#: The lattice's unit for vectors of one dimension; it shrinks with the root of the dimensions, as projections do.
SCALE = 1.28
#: Rows of a tile: those lying in a cell, and those asking.
BLOCK, ASKING = 2048, 32768
#: Cells with tiles are broadcast up to so many (some 30 MB), else joined by hash.
BROADCAST_CELLS = 1 << 20
_UNIT = 1 << 20


def _roots() -> np.ndarray:
    """The 240 lattice points next to the origin."""
    out = np.zeros((240, 8))
    for n, ((i, j), (a, b)) in enumerate(product(combinations(range(8), 2), product((1, -1), repeat=2))):
        out[n, [i, j]] = a, b
    halves = np.array(list(product((0.5, -0.5), repeat=8)))
    out[112:] = halves[(halves < 0).sum(axis=1) % 2 == 0]
    return out


ROOTS = _roots()


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row: the better of the nearest even-sum points with whole and with half coordinates."""
    best, least = np.zeros_like(x), np.full(len(x), np.inf)
    for shift in (0.0, 0.5):
        p = np.rint(x - shift)
        e = x - shift - p
        odd = np.flatnonzero(p.sum(axis=1).astype(np.int64) & 1)
        worst = np.abs(e[odd]).argmax(axis=1)
        p[odd, worst] += np.where(e[odd, worst] >= 0, 1.0, -1.0)
        p += shift
        d = ((x - p) ** 2).sum(axis=1)
        nearer = d < least
        best[nearer], least[nearer] = p[nearer], d[nearer]
    return best


class Lattice:
    """Tables of cells for vectors of a number of dimensions. The same numbers in every task."""

    def __init__(self, dims: int, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> None:
        rng, wide = np.random.default_rng(8), max(8, dims)
        a: list[np.ndarray] = []
        while len(a) < tables:
            q = np.linalg.qr(rng.normal(size=(wide, wide)))[0]
            a += [q[:dims, k : k + 8] for k in range(0, wide - 7, 8)]
        self.tables, self.probes, self.scale = tables, probes, scale / wide**0.5
        self.projection = np.rint(np.stack(a[:tables]) * _UNIT)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, 1 + probes): each row's own cell and the neighbouring ones that it asks, as numbers of 64 bits."""
        whole = np.rint(unit * _UNIT)
        out = np.zeros((len(unit), self.tables, 1 + self.probes), np.int64)
        for t, a in enumerate(self.projection):
            x = (whole @ a) / (_UNIT * _UNIT * self.scale)
            p = nearest_point(x)
            rest = np.rint((x - p) * _UNIT)
            near = np.argpartition(-(rest @ ROOTS.T), self.probes, axis=1)[:, : self.probes] if self.probes else np.zeros((len(p), 0), int)
            points = np.concatenate((p[:, None], p[:, None] + ROOTS[near]), axis=1)
            out[:, t] = (points * 2).astype(np.int8).view(np.int64)[..., 0]
        return out


def units(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # no overflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def met_before(q: np.ndarray, i: np.ndarray, table: int) -> np.ndarray:
    """Which pairs of rows, by their cells, meet in a table before this one."""
    seen = np.zeros(len(q), bool)
    for t in range(table):
        seen |= (q[:, t] == i[:, t, :1]).any(axis=1) | (i[:, t] == q[:, t, :1]).any(axis=1)
    return seen


def tile(lattice: Lattice, cosine: float) -> Callable[[Columns], Callable[[Columns], list[Columns]] | None]:
    """Compares the classes of a cell with those that ask there; see meet()."""

    def build(index: Columns) -> Callable[[Columns], list[Columns]]:
        unit, first = units(index["v"]), [bool(index["part"][0] < 0)]
        table = int(index["tab"][0])

        def links(q: Columns, uq: np.ndarray) -> list[Columns]:
            out = []
            step = max(1, (1 << 21) // len(unit))
            for at in range(0, len(uq), step):
                a, b = np.nonzero(uq[at : at + step] @ unit.T >= cosine)
                a += at
                rq, ri = q["row"][a], index["row"][b]
                # a cell's own rows meet twice: once counts
                fits = np.where(q["role"][a] < 2, rq < ri, rq != ri)
                a, b, rq, ri = a[fits], b[fits], rq[fits], ri[fits]
                if not len(a):
                    continue
                ua, xa = np.unique(a, return_inverse=True)
                ub, xb = np.unique(b, return_inverse=True)
                ca, cb = lattice.cells(uq[ua]), lattice.cells(unit[ub])
                ok = np.ones(len(a), bool)
                for s in range(0, len(a), 1 << 17):
                    x, y = ca[xa[s : s + (1 << 17)]], cb[xb[s : s + (1 << 17)]]
                    asked = (y[:, table, 1:] == x[:, table, :1]).any(axis=1) & (q["role"][a[s : s + (1 << 17)]] == 2)
                    ok[s : s + (1 << 17)] = ~met_before(x, y, table) & ~(asked & (rq[s : s + (1 << 17)] > ri[s : s + (1 << 17)]))
                a, b, rq, ri = a[ok], b[ok], rq[ok], ri[ok]
                if not len(a):
                    continue
                ids, least = labels(rq, ri)
                n = np.zeros(len(ids), np.int64)
                np.add.at(n, np.searchsorted(ids, rq), index["mult"][b])
                np.add.at(n, np.searchsorted(ids, ri), q["mult"][a])
                out.append({"row": ids, "least": least, "n": n})
            return out

        def ask(q: Columns) -> list[Columns]:
            out = []
            if first[0]:  # not dealt as tiles: the cell's own rows ask here
                first[0] = False
                out += links(index, unit)
            if len(q["row"]):
                out += links(q, units(q["v"]))
            return out

        return ask

    return build


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    dims = max(1, vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)
    kind = "f8" if dict(vectors.dtypes)["embedding"] == "array<double>" else "f4"
    lattice = Lattice(dims, tables, probes, scale)

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, whole = dense(b.column("embedding"), dims)
            whole &= (m != 0).any(axis=1)
            v = packed((m + 0.0).astype(kind))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pc.if_else(pa.array(whole), v, pa.scalar(None, pa.binary()))], ["row", "vec_id", "v"])

    own = numbered(vectors.select(F.col("vec_id").cast("long").alias("doc_id"), "embedding")).select("row", F.col("doc_id").alias("vec_id"), "doc.embedding")
    rows = stage(own.mapInArrow(to_bytes, "row long, vec_id long, v binary"), "vectors")
    classes = stage(rows.filter("v is not null").groupBy("v").agg(F.min("row").alias("row"), F.count("*").alias("mult"), F.min("vec_id").alias("first_id")), "classes")

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = lattice.cells(units(matrix(b.column("v"), kind)))
            for t in range(tables):
                cell, n = np.unique(cells[:, t, 1:], return_counts=True)
                own, m = np.unique(cells[:, t, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell) + len(own), t, np.int32)), pa.array(np.concatenate((cell, own))), pa.array(np.concatenate((n * 0, m))), pa.array(np.concatenate((n, m)))], ["tab", "cell", "lying", "asking"])

    counted = classes.select("v").mapInArrow(count_cells, "tab int, cell long, lying long, asking long").groupBy("tab", "cell").agg(F.sum("lying").alias("lying"), F.sum("asking").alias("asking"))
    tiled = stage(counted.filter((F.col("lying") > BLOCK) | (F.col("lying") > 0) & (F.col("asking") > ASKING)).select("tab", "cell", F.ceil(F.col("lying") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asking") / ASKING).cast("int").alias("turns")), "tiled")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                cells = lattice.cells(units(matrix(s.column("v"), kind)))
                n, per = s.num_rows, tables * (1 + probes)
                take = pa.array(np.repeat(np.arange(n), per))
                tab = np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + probes), n)
                role = np.tile(np.where(np.arange(1 + probes) == 0, 0, 2).astype(np.int32), n * tables)
                yield pa.RecordBatch.from_arrays([pa.array(tab), pa.array(cells.ravel()), pa.array(role), *(s.column(c).take(take) for c in ("row", "mult", "v"))], ["tab", "cell", "role", "row", "mult", "v"])

    dealt = classes.select("row", "mult", "v").mapInArrow(deal, "tab int, cell long, role int, row long, mult long, v binary")
    if many := tiled.count():
        hot = F.broadcast(tiled) if many <= BROADCAST_CELLS else tiled
        of = lambda c: F.pmod(F.xxhash64("row"), F.col(c)).cast("int")
        plain = dealt.join(hot, ["tab", "cell"], "left_anti").withColumns({"part": F.lit(-1), "turn": F.lit(-1)})
        t = dealt.join(hot, ["tab", "cell"])
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        lying = t.filter("role = 0").withColumn("part", of("blocks")).withColumn("turn", every("turns"))
        asking = t.withColumn("role", F.greatest("role", F.lit(1))).withColumn("turn", of("turns")).withColumn("part", every("blocks"))
        dealt = plain.unionByName(lying.unionByName(asking).drop("blocks", "turns"))
    else:
        dealt = dealt.withColumns({"part": F.lit(-1), "turn": F.lit(-1)})
    # part and tab also as columns, for the task to read
    found = stage(meet(dealt.withColumnRenamed("cell", "c").withColumns({"t": F.col("tab"), "p": F.col("part")}), ["t", "c", "p", "turn"], {"v": kind}, tile(lattice, cosine), "row long, least long, n long"), "links")
    linked = found.groupBy("row").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("row").alias("u"), F.col("least").alias("v"))).withColumnRenamed("id", "row")
    c = classes.select("row", "mult", "first_id").join(linked, "row", "left").join(joined, "row", "left").withColumn("component", F.coalesce("component", "row"))
    least = c.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("w"))
    c = attach(c, least, ["component"], "w", classes.count())
    c = classes.select("v", "row").join(c, "row").select("v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id", "mult", F.lit(True).alias("valid"))
    out = attach(rows.filter("v is not null"), c, ["v"], "mult", rows.count()).select("vec_id", "n_links", "component_id", "valid")
    out = out.unionByName(rows.filter("v is null").select("vec_id", F.expr("0L").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(False).alias("valid")))
    return out.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs; the index finds those that it finds.
OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a), linked AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN linked k ON k.a = e.vec_id
"""
