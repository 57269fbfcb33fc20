"""Runs a per-text scanner over whole texts in Arrow batches."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import small_batches

#: kind, start, end in code points, end exclusive.
Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: list[Span]) -> str:
    return sha256(joined(spans).encode()).hexdigest()


def apart(spans: Iterable[Span], taken: Iterable[Span]) -> list[Span]:
    """The spans that overlap none of taken."""
    order = sorted((s, e) for _, s, e in taken)
    begins, reach = [s for s, _ in order], list(accumulate((e for _, e in order), max))
    # of those that begin before a span's end, the one that reaches farthest
    return [x for x in spans if not (k := bisect.bisect_left(begins, x[2])) or reach[k - 1] <= x[1]]


def scan(docs: DataFrame, find: Callable[[str], tuple], schema: str) -> DataFrame:
    """doc_id and the columns of schema (name type, ...) that find(text) returns; a null text is empty."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(",")]
    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([x[i] for x in found], t) for i, t in enumerate(types))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")
