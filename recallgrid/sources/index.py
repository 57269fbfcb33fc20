"""The inverted index of a set of rows as stored tables, built once for each state of its input and session.

Postings lie sorted by owner and term, with each row's length beside them, so a query joins the asked terms
and nothing else. They are written to the shared folder that spark.checkpoint.dir names (to a
local one only in local mode).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.functions.text import WORD_GAP

_BUILT: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/recallgrid-tables"
    return root.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, so that what builds on it doesn't compute it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Distinct words whose terms a task remembers, and bytes of input for each partition of the postings.
WORDS, SHARE = 1 << 18, 8 << 20


def counting(term: Callable[[str], str | None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """owner, term, id, dl, tf of rows with words (lists, or texts of them): a row's terms are counted where it is, a few rows at once.

    term gives the term of a word, or None where it is none (without it words are terms); it is asked once for each different word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                lists = s.column("words")
                lists = lists if pa.types.is_list(lists.type) else pc.split_pattern_regex(lists, WORD_GAP)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
                row = np.repeat(np.arange(s.num_rows), sizes)
                words = lists.flatten().dictionary_encode()
                terms, place = words.dictionary, words.indices.to_numpy()
                if term and len(terms):
                    known = known if len(known) < WORDS else {}
                    for w in (seen := terms.to_pylist()):
                        if w not in known:
                            known[w] = term(w)
                    of = pa.array([known[w] for w in seen], terms.type).dictionary_encode()
                    terms, place = of.dictionary, of.indices.fill_null(-1).to_numpy()[place]
                    row, place = row[place >= 0], place[place >= 0]
                n = max(1, len(terms))
                key, tf = np.unique(row * n + place, return_counts=True)
                dl, row = np.bincount(row, minlength=s.num_rows), key // n
                at_ = pa.array(row)
                yield pa.RecordBatch.from_arrays([s.column("owner").take(at_), terms.take(pa.array(key % n)), s.column("id").take(at_), pa.array(dl[row].astype(np.int64)), pa.array(tf.astype(np.int64))], ["owner", "term", "id", "dl", "tf"])

    return run


counted = counting()


def write_postings(rows: DataFrame, words: F.Column, path: str, term: Callable[[str], str | None] | None = None, size: int = 0) -> None:
    """rows: owner, id (one row each) and what words reads; writes postings (owner, term, id, tf, dl) and sizes (owner, n, total).

    Texts are read once: the terms of an owner are summed from the postings. size is that of the input in bytes; the number of partitions grows with it.
    """
    p = rows.select("owner", "id", words.alias("words")).mapInArrow(counting(term), "owner string, term string, id long, dl long, tf long")
    parts = size // SHARE
    by = (parts,) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    p.repartition(*by, "owner", "term").sortWithinPartitions("owner", "term").write.parquet(f"{path}/postings")
    total = rows.sparkSession.read.parquet(f"{path}/postings").groupBy("owner").agg(F.sum("tf").alias("total"))
    n = rows.groupBy("owner").agg(F.count("*").alias("n"))
    n.join(total, n["owner"].eqNullSafe(total["owner"]), "left").select(n["owner"], "n", F.coalesce("total", F.lit(0).cast("long")).alias("total")).write.parquet(f"{path}/sizes")


def files(spark: SparkSession, *paths: str) -> list[tuple[str, int, int]]:
    """Name, size and time of the files of tables (one listing a table)."""
    seen = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        seen += [(x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in (fs.listStatus(p) if fs.exists(p) else [])]
    return seen


def version(spark: SparkSession, *paths: str) -> int:
    """A number that changes with the names, sizes or times of the files of tables."""
    return hash(tuple(sorted(files(spark, *paths))))


def postings(spark: SparkSession, key: str, rows: Callable[[], DataFrame], words: F.Column, inputs: tuple[str, ...] = (), term: Callable[[str], str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """postings and sizes of rows(), which key stands for in this session, as long as the files of inputs stay as they are."""
    k = (spark.sparkContext.applicationId, key, version(spark, *inputs))
    if k not in _BUILT:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        write_postings(rows(), words, path, term, sum(x[1] for x in files(spark, *inputs)))
        _BUILT[k] = path
    return spark.read.parquet(f"{_BUILT[k]}/postings"), spark.read.parquet(f"{_BUILT[k]}/sizes")
