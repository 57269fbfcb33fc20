"""Removal of byte strings that repeat, by suffix sorting.

Every 200-byte window holds an anchor: the least hash of its 100-byte grams, the first of equals.
The anchor depends on the window alone, so equal windows of any two documents share it. Windows in a
row with the same anchor are a run; runs are dealt by the anchor's hash and sorted there on disk:
(1) a run that is alone with its anchor can't repeat; (2) runs that are equal as a whole, seen by a
digest of all their bytes, repeat; (3) of the others (at the edges of a repeat) one run of each
digest goes, with its bytes, to a suffix array: suffixes smaller than their successors are
sorted directly, the rest are induced by bucket scans, and adjacent suffixes with a common prefix of
200 bytes or more repeat. Only starts of windows are sorted. The work is in proportion to the text
and, for (3), to the edges of repeats.

A passage that very many texts share makes its anchors hot: their runs are sorted in one task, on disk, and the
different ones at the passage's edges are one suffix block.

Defined results: null texts are empty; texts shorter than the length have nothing removed; repeated
rows are each other's copies, so all their bytes go if they are long enough, and each gives a
result row; null doc_id as any other; a text of any length is read whole; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import chunks, documents, mix64, prefix_hash, small_batches, span_hash, stage

LENGTH, GRAM = 200, 100
#: Bits of a place in a chunk (no chunk and no text has more bytes); the others are the hash's.
PLACE_BITS = 32


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row (block prefixes and suffixes)."""
    n = len(x)
    pad = np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.concatenate((x, pad)).reshape(-1, w)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each run of windows: text's index, anchor's hash, digest, first start, last start."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(lens)))
    u = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(u) < length:
        return empty, empty.view(np.uint64), empty.view(np.uint64), empty, empty
    c, inv = prefix_hash(u)
    g = mix64((c[gram:] - c[:-gram]) * inv[: len(c) - gram])
    low = np.uint64((1 << PLACE_BITS) - 1)
    # the high bits of the hash, then the place: the first of equals is least, whatever else is in the chunk
    key = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    anchor = (sliding_min(key, length - gram + 1) & low).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.searchsorted(at, start, side="right") - 1
    whole = start + length <= at[text + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & whole)
    cut = np.flatnonzero(new | ~whole)
    after = np.append(cut, len(anchor))[np.searchsorted(cut, first, side="right")]
    last = after - 1
    # the anchor's place in the run is part of the digest
    d = span_hash(c, inv, first, last + length) ^ mix64((anchor[first] - first).astype(np.uint64) + np.uint64(1))
    t = text[first]
    return t, g[anchor[first]], d, first - at[t], last - at[t]


# --- suffix array of part of the suffixes, by two-stage sorting ---------------------------------


def _keys(u: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number (zeros behind the end)."""
    k = np.zeros(len(u), np.uint64)
    padded = np.concatenate((u, np.zeros(8, np.uint8)))
    for j in range(8):
        k = (k << np.uint64(8)) | padded[j : j + len(u)].astype(np.uint64)
    return k


def suffix_order(u: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """starts in the order of the first depth bytes of their suffixes (equal ones in any order)."""
    n = len(u)
    ahead = np.append(u[1:], np.uint8(0))
    # smaller than the successor: the next different byte is larger
    differ = np.flatnonzero(u != ahead)
    at = np.searchsorted(differ, np.arange(n))
    small = np.append(u[differ] < ahead[differ], False)[at]
    # a suffix to be induced needs its successor, down to one that is sorted directly or ends the text
    wanted = np.zeros(n + 1, bool)
    wanted[starts] = True
    todo = starts[~small[starts]] + 1
    while len(todo := todo[(todo < n) & ~wanted[np.minimum(todo, n)]]):
        wanted[todo] = True
        todo = todo[~small[todo]] + 1
    places = np.flatnonzero(wanted[:n])
    direct, rest = places[small[places]], places[~small[places]]
    keys = np.concatenate((_keys(u), np.zeros(depth + 8, np.uint64)))
    order = direct[np.argsort(keys[direct], kind="stable")]
    tied = np.zeros(len(order), np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    tied[1:] = np.cumsum(~same)
    for at in range(8, depth, 8):
        size = np.bincount(tied, minlength=1)
        more = np.flatnonzero(size[tied] > 1)
        if not len(more):
            break
        k = keys[np.minimum(order[more] + at, len(keys) - 1)]
        again = np.lexsort((k, tied[more]))
        order[more] = order[more][again]
        k, group = k[again], tied[more]
        new = np.zeros(len(order), bool)
        new[more[1:]] = (k[1:] != k[:-1]) & (group[1:] == group[:-1])
        tied = tied + np.cumsum(new)
    rank = np.full(n + 1, -1, np.int64)  # the end of the text comes before all
    out = np.zeros(len(places), np.int64)
    d_at, r_of = np.searchsorted(u[order], np.arange(257)), u[rest]
    by_byte = rest[np.argsort(r_of, kind="stable")]
    r_at = np.searchsorted(np.sort(r_of), np.arange(257))
    done = 0
    for byte in np.unique(u[places]).tolist():
        mine = by_byte[r_at[byte] : r_at[byte + 1]]
        # scan: first those before a lower byte, in their successors' order, then step by step those before them
        wave = mine[(mine + 1 >= n) | (np.append(u, 0)[mine + 1] != byte)]
        wave = wave[np.argsort(rank[wave + 1], kind="stable")]
        left = np.zeros(n, bool) if len(wave) < len(mine) else None
        if left is not None:
            left[mine] = True
        while len(wave):
            out[done : done + len(wave)] = wave
            rank[wave] = np.arange(done, done + len(wave))
            done += len(wave)
            if left is None:
                break
            left[wave] = False
            back = wave - 1
            wave = back[(back >= 0) & left[np.maximum(back, 0)]]
        own = order[d_at[byte] : d_at[byte + 1]]
        out[done : done + len(own)] = own
        rank[own] = np.arange(done, done + len(own))
        done += len(own)
    return out


def repeated_starts(u: np.ndarray, starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Those of starts (each with depth bytes in its own text) whose first depth bytes start at another of them too."""
    if len(starts) < 2:
        return starts[:0]
    mine = np.zeros(len(u), bool)
    mine[starts] = True
    order = suffix_order(u, starts, depth)
    order = order[mine[order]]
    keys = _keys(u)
    same = np.ones(len(order) - 1, bool)
    a, b = order[:-1], order[1:]
    for at in [*range(0, depth - 7, 8), depth - 8]:
        live = np.flatnonzero(same)
        same[live] = keys[a[live] + at] == keys[b[live] + at]
    twice = np.zeros(len(order), bool)
    twice[:-1] |= same
    twice[1:] |= same
    return np.sort(order[twice])


# --- the job -----------------------------------------------------------------------------------


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """row, s, e: windows that start in [s, e] of a text repeat. docs: row, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches):
            t, g, d, s, e = runs(texts, length, gram)
            yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(t)), pa.array(g.view(np.int64)), pa.array(d.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))], ["row", "anchor", "digest", "s", "e"])

    r = docs.mapInArrow(cut, "row long, anchor long, digest long, s int, e int")
    one = Window.partitionBy("anchor").orderBy("digest")
    r = r.withColumn("prev", F.lag("digest").over(one)).withColumn("next", F.lead("digest").over(one))
    # alone with the anchor: neither neighbour
    r = r.filter("prev is not null or next is not null")
    r = r.withColumn("copy", F.coalesce(F.expr("prev = digest"), F.lit(False)) | F.coalesce(F.expr("next = digest"), F.lit(False)))
    r = r.withColumn("head", F.coalesce(F.expr("prev <> digest"), F.lit(True)))
    r = stage(r.select("row", "anchor", "s", "e", "copy", "head"), "runs")
    whole = r.filter("copy").select("row", "s", "e")
    # one run of each digest where an anchor has several
    several = r.filter("head").select("anchor", "row", "s", "e").withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).filter("n > 1")
    asked = several.groupBy("row").agg(F.collect_list(F.struct("anchor", "s", "e")).alias("runs"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for row, text, rs in zip(b.column("row").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("runs").to_pylist()):
                for x in rs:
                    for c, v in zip(cols, (row, x["anchor"], x["s"], text[x["s"] : x["e"] + length])):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], ["row", "anchor", "s", "bytes"])

    parts = docs.join(asked, "row").mapInArrow(contexts, "row long, anchor long, s int, bytes binary")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, anchor = [], 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("row", "anchor", "s", "bytes"))):
                if size > BLOCK and row[1] != anchor:
                    yield from solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3]) + 1
                anchor = row[1]
        yield from solve(held)

    def solve(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        u = np.frombuffer(b"\0".join(x[3] for x in held) + b"\0", np.uint8)
        lens = np.fromiter((len(x[3]) for x in held), np.int64, len(held))
        begin = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
        n = lens - length + 1
        starts = np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        found = repeated_starts(u, starts, length)
        k = np.searchsorted(begin, found, side="right") - 1
        place = found - begin[k] + np.fromiter((x[2] for x in held), np.int64, len(held))[k]
        new = np.ones(len(found), bool)
        new[1:] = (k[1:] != k[:-1]) | (place[1:] != place[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(found)) - 1 if len(found) else first
        rows = np.fromiter((x[0] for x in held), np.int64, len(held))
        yield pa.RecordBatch.from_arrays([pa.array(rows[k[first]]), pa.array(place[first].astype(np.int32)), pa.array(place[last].astype(np.int32))], ["row", "s", "e"])

    edges = parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(sort, "row long, s int, e int")
    return whole.unionByName(edges)


#: Bytes of edge runs in one suffix array, besides the rest of the last anchor's.
BLOCK = 2 << 20


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    # doc_id names a row, unless rows share one or lack it; then a number is given, by a stage table so that reruns agree
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        docs = docs.withColumn("row", F.col("doc_id"))
    else:
        docs = stage(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    spans = repeats(docs.select("row", "text"), length).groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, found in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist()):
                kept, at, removed, n = [], 0, 0, 0
                end = -1
                for s, e in sorted((x["s"], x["e"] + length) for x in found or ()):
                    if s > end:
                        kept.append(text[at:s])
                        n += 1
                        removed += e - s
                        at = end = e
                    elif e > end:
                        removed += e - end
                        at = end = e
                kept = b"".join([*kept, text[at:]])
                out.append((len(text), removed, n, sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("kept")
