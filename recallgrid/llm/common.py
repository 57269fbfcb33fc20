"""Shared parts: stage tables, byte-level word hashing and bounded id filters."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes; the same set as bytes.split() without arguments.
SEPARATORS = b" \t\n\x0b\x0c\r"
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"
#: Rows and bytes that a Python worker holds at a time (one longer text is held alone).
BATCH_ROWS, CHUNK_BYTES = 1000, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stage_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only in local mode, where tests leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/recallgrid-stages"
    return root.rstrip("/")


_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCOPES: list[list[tuple[SparkSession, str]]] = []


def stage(df: DataFrame, name: str, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The stage tables in spent aren't needed by anything but df; they are deleted once it is written.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[out] = path
    if _SCOPES:
        _SCOPES[-1].append((spark, path))
    free(*spent)
    return out


def free(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch() -> Iterator[None]:
    """All stage tables made inside are deleted at the end; what is to last is written by the caller with kept()."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for spark, path in _SCOPES.pop():
            _delete(spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """A stage table that the surrounding scratch() leaves."""
    inner, _SCOPES[:] = list(_SCOPES), []
    try:
        return stage(df, name)
    finally:
        _SCOPES[:] = inner


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id, doc: each row of docs (whole, as doc) with a key that any scan gives again.

    The key is doc_id; where rows share one or lack it, numbers are given and written to a stage table.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    if d.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return d.select(F.col("doc_id").alias("row"), "doc_id", "doc")
    return stage(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", "doc"), "numbered")


#: A key that more than one row in HOT has is hot; there are fewer than HOT such keys in any table. A table of FEW rows is no burden to any task.
HOT, FEW = 2000, 20_000


def attach(left: DataFrame, right: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """left with the columns of right, null where that has no row of the key.

    right has one row a key, and in weight how many of the total rows of left have it. Hot keys are fewer
    than HOT, so theirs are broadcast and their rows stay where they lie; all others are joined by hash.
    """
    if total <= FEW:
        return left.join(right.drop(weight), on, "left")
    hot = F.broadcast(right.filter(F.col(weight) * HOT > total).drop(weight))
    rest = right.filter(F.col(weight) * HOT <= total).drop(weight)
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(rest, on, "left"))


# --- hashing of words in a byte buffer -------------------------------------------------------

_RNG = np.random.default_rng(20240201)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _POWERS[k] = np.multiply.accumulate(a)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums C with C[i] over u[:i], and P**-i; hash of [s, e) is (C[e]-C[s])*inv[s]."""
    p, inv = powers(len(u) + 1)
    c = np.zeros(len(u) + 1, np.uint64)
    np.cumsum(_BYTE[u] * p[:-1], out=c[1:])
    return c, inv


def span_hash(c: np.ndarray, inv: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix64((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer."""
    inside = np.zeros(len(u) + 2, np.int8)
    inside[1:-1] = ~_IS_SEP[u]
    d = np.diff(inside)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with the texts as UTF-8 (null: empty), each of CHUNK_BYTES or one text."""
    for b in batches:
        if not b.num_rows:
            continue
        texts = pc.fill_null(b.column(text).cast(pa.binary()), b"").to_pylist()
        at = size = 0
        for i, t in enumerate(texts):
            if i > at and size + len(t) > CHUNK_BYTES:
                yield b.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t)
        yield b.slice(at), texts[at:]


def hashed_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and bounds: the words of text i are [bounds[i], bounds[i+1])."""
    u = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        u = LOWER[u]
    s, e = word_spans(u)
    c, inv = prefix_hash(u)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return span_hash(c, inv, s, e), np.concatenate(([0], np.searchsorted(s, ends)))


# --- bounded filter on ids -------------------------------------------------------------------

FILTER_BITS = 1 << 22


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """A bitmap of fixed size that holds every id of the column (others pass by chance, joins settle those)."""
    bit = F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))
    rows = ids.select(F.shiftright(bit, 5).alias("w"), F.expr("1L").alias("one"), bit.alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, cast(b % 32 as int))")).alias("v")).collect()
    out = np.zeros(FILTER_BITS // 32, np.int64)
    for r in rows:
        out[r["w"]] = r["v"]
    return out


def in_filter(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 5] >> (bit & 31)) & 1 == 1


# --- connected components --------------------------------------------------------------------


#: So many links are joined up by one task, in some 100 MB; more of them by rounds over tables.
FEW_LINKS = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (id, component): the smallest id reachable, for every id with a link.

    Beyond FEW_LINKS by alternating large and small stars: the number of rounds grows with the logarithm
    of the longest path; each round is a stage table. A hub of very many links is a hot key, see attach().
    """
    e = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    if e.count() <= FEW_LINKS:
        return e.repartition(1).mapInArrow(_joined, "id long, component long")
    c = _stars(e)
    return c.unionByName(c.select(F.col("component").alias("id"), "component").distinct())


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all links of one task, by taking the least label along links and then the label's label."""
    links = [np.stack((b.column("u").to_numpy(), b.column("v").to_numpy())) for b in batches]
    ids, at = np.unique(np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64), return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def _stars(e: DataFrame) -> DataFrame:
    seen = None
    while True:
        total = 2 * e.count()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("c"))
        large = attach(both, low, ["u"], "c", total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        linked = attach(large, least, ["u"], "c", total)
        small = linked.select("u", F.col("m").alias("v")).unionByName(linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = stage(small, "cc", (e,))
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
