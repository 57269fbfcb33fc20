"""Vectors as bytes, and the rows of groups that meet in the task they are dealt to, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as the rows of a matrix of that kind."""
    if not len(column):
        return np.zeros((0, 0), kind)
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), -1)


def packed(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.itemsize
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(m.tobytes())])


def dense(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as float64 rows, padded with zeros to width, and which of them are whole: not null, all components finite."""
    out = np.zeros((len(column), width))
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    sizes = np.fromiter((0 if x is None else x for x in pc.list_value_length(column).to_pylist()), np.int64, len(column))
    r = np.repeat(np.arange(len(column)), sizes)
    k = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    good = np.isfinite(values)
    out[r[good], k[good]] = values[good]
    whole = ~column.is_null().to_numpy(zero_copy_only=False)
    whole[r[~good]] = False
    return out, whole


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that are linked by pairs, and of each the least id reachable: as many links as ids, whatever the number of pairs."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[tuple[tuple, pa.RecordBatch | None]]:
    """Runs of rows with equal keys (numbers), each as one batch; None in place of a run of more than most rows, which isn't held."""
    key, held, n = None, [], 0

    def whole() -> tuple[tuple, pa.RecordBatch | None]:
        return key, held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else None

    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        starts = np.append(0, np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist()
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            if key != (now := tuple(k[:, s].tolist())):
                if key is not None:
                    yield whole()
                key, held, n = now, [], 0
            n += e - s
            held = [*held, b.slice(s, e - s)] if n <= most else []
    if key is not None:
        yield whole()


Columns = dict[str, np.ndarray]


def meet(rows: DataFrame, keys: list[str], kinds: dict[str, str], build: Callable[[Columns], Callable[[Columns], list[Columns]] | None], schema: str, alone: bool = False, late: tuple[Callable[[DataFrame], DataFrame], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], list[str]] | None = None, piece: int = 0) -> DataFrame:
    """What the queries of each group get from its index.

    rows has the keys (numbers), role (0: index, others: queries) and columns, binary ones as matrices of the
    kind that kinds gives. A group's index rows come first and are held; its queries stream past in batches.
    build() takes the index and gives a function of queries; groups without an index are passed over, and so
    are groups of a single row unless alone. The caller bounds how many index rows a group has.

    late (a join, a function of batches and the names of its columns) gives rows what doesn't travel, after they are dealt and
    sorted; it must keep their order. With piece, so many queries are asked at once, and what they get goes on before the next are.
    """
    names = [c for c in (late[2] if late else rows.columns) if c not in keys]
    target = [x.split()[0] for x in schema.split(", ")]
    # tasks get the function alone: the join holds a table
    given = late[1] if late else iter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ask = None, [], None

        def part(cols: Columns, s: int, e: int) -> Columns:
            return {c: x[s:e] for c, x in cols.items()}

        def sent(out: list[Columns]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in target], target)

        def joined(parts: list[Columns]) -> Columns:
            return parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

        for b in given(batches):
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
            cols = {c: matrix(b.column(c), kinds[c]) if c in kinds else b.column(c).to_numpy(zero_copy_only=False) for c in names}
            new = np.ones(b.num_rows, bool)
            new[1:] = (k[:, 1:] != k[:, :-1]).any(axis=0)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], b.num_rows)
            role, out = cols["role"], []
            # the first may go on with the last group; the last may go on in the next batch
            live = (role[starts] == 0) & ((ends - starts > 1) | alone)
            live[0] = live[-1] = True
            for s, e in zip(starts[live].tolist(), ends[live].tolist()):
                if key != (now := tuple(k[:, s].tolist())):
                    if held and ask is None and (alone or sum(len(p["role"]) for p in held) > 1):
                        build_only = build(joined(held))
                        out += build_only(part(cols, 0, 0)) if build_only else []
                    key, held, ask = now, [], None
                m = s + int(np.searchsorted(role[s:e], 1))
                if m > s:
                    held.append({c: x.copy() for c, x in part(cols, s, m).items()} if e == b.num_rows else part(cols, s, m))
                if m < e and held:
                    ask = ask or build(joined(held))
                    for q in range(m, e if ask else m, piece or e - m):
                        out += ask(part(cols, q, min(e, q + piece) if piece else e))
                        if piece and out:
                            yield sent(out)
                            out = []
            if out:
                yield sent(out)
        if held and ask is None and (alone or sum(len(p["role"]) for p in held) > 1):
            ask = build(joined(held))
            out = ask({c: x[:0] for c, x in held[0].items()}) if ask else []
            if out:
                yield sent(out)

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, *[F.col(c) for c in keys]).sortWithinPartitions(*keys, "role")
    # a numbered row keeps the optimizer from dropping the sort below a join
    return (late[0](dealt.withColumn("_n", F.monotonically_increasing_id())) if late else dealt).mapInArrow(run, schema)
