"""N-gram Jaccard join by prefix trees.

Each document is the set of its 5-word shingles, kept in one global order (rare shingles first).
Two sets with a Jaccard similarity of 3/4 share a shingle among the first n - ceil(3n/4) + 1 of
each, so only those prefixes are dealt out. Texts that meet at a shingle are verified by whole sets:
the sets of a block form a trie, and every probe of the block walks it, counting each shared path once
and leaving subtrees that the remaining lengths can't bring to the needed overlap. Before that,
parities of the hashes of a set (two to four a shingle, so that long texts have more) bound from
below how many shingles two texts don't share, which spares most texts that aren't similar.

Order of the work: (1) a fixed-size counter sketch over all shingles gives the order; (2) equal sets
become one class; (3) prefixes are dealt by shingle, those alone in a shingle go; (4) each class is
held against the leaders of its shingles, which links the bulk of a group of near copies in linear
time; (5) pairs of different components that still meet are held against each other, the most
frequent component of a shingle never against itself; before they meet, rounds join up such components,
as long as a round leaves clearly fewer pairs. Where many would meet a large component, they are held
against one member of it, the centre, and those near it meet at shingles in which they differ from the
centre, not at those that the whole group has. Every pair that could link is either verified
or already connected. Shingles are known by 64 bits throughout.

Hot keys: a shingle that the sketch counts far above the others is dealt in parts (whose leaders are
held against each other), groups of copies are summed up before they are dealt, and hot classes,
shingles and hubs are joined by attach().

Defined results: every row is a document of its own, also where rows share a doc_id (that alone links
nothing) or lack it (it can be linked, but gives no component_id); null, empty or wordless texts have
n_shingles 0 and only themselves; equal rows give equal result rows; a text of any length is one
set; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import attach, chunks, components, documents, hashed_words, id_filter, in_filter, mix64, numbered, small_batches, stage

WORDS = 5
SKETCH_BITS, SKETCH_BLOCKS = 21, 64
#: Pairs that one trie is made for; more are split over several tries, each walked by the same probes.
TRIE_SETS = 256
#: A cell of the sketch with so many documents above eight times the mean is dealt in parts; rows of one task where a shingle's texts meet.
HOT_CELL, MEETING = 1000, 5000
#: Rounds at most that join up components which meet often, before all pairs left are held against each other.
ROUNDS = 6
#: A shingle where more rows than this would meet a component of more than this is refined by what its texts differ in from a centre.
OUTSIDE = 16
#: A round that leaves more than this share of the pairs that would meet was the last; longs of the parities that pairs are held against each other by where they meet.
WORTH, FOLDED = 0.75, 4
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a shorter text is one shingle."""
    w, at = hashed_words(texts)
    n = max(0, len(w) - words + 1)
    s = np.zeros(n, np.uint64)
    for j in range(words):
        s += w[j : j + n] * (_MUL[j % 5] + np.uint64(2 * (j // 5)))
    s = mix64(s)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            out.append(np.unique(s[a : b - words + 1]))
        elif b > a:
            short = w[a:b] * _MUL[np.arange(b - a) % 5]
            out.append(mix64(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _cells(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _ordered(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return s[np.argsort(counts[_cells(s)], kind="stable")]


def _parities(s: np.ndarray) -> np.ndarray:
    """How many of the hashes fall on each bit, modulo 2; the least power of two that gives each hash two bits, 64 at least."""
    size = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def shingle_counts(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many documents hold a shingle of each of 2**SKETCH_BITS cells; the array is the same size for any corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, texts in chunks(batches):
            total += np.bincount(_cells(np.concatenate(shingle_sets(texts, words))), minlength=1 << SKETCH_BITS)
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(np.minimum(total, 2**31 - 1).astype(np.int32), SKETCH_BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], ["block", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_BLOCKS, np.int64)
        for x in pdf["part"]:
            total += np.frombuffer(zlib.decompress(x), np.int32)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)]})

    out = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int32)
    for r in docs.select("text").mapInArrow(count, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary").collect():
        out[r["block"]] = np.frombuffer(zlib.decompress(r["part"]), np.int32)
    return out.ravel()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(flat))


class Trie:
    """Sets in global order as paths; runs without a branch are one node."""

    def __init__(self) -> None:
        self.root = [np.zeros(0, np.uint64), {}, [], 1 << 60, 0]  # tokens, children, ends, least size, longest rest

    def add(self, name: int, path: np.ndarray) -> None:
        node, n, rest = self.root, len(path), path
        node[3], node[4] = min(node[3], n), max(node[4], len(rest))
        while len(rest):
            child = node[1].get(int(rest[0]))
            if child is None:
                node[1][int(rest[0])] = [rest, {}, [(name, n)], n, len(rest)]
                return
            seg = child[0]
            k = min(len(seg), len(rest))
            differ = np.flatnonzero(seg[:k] != rest[:k])
            k = int(differ[0]) if len(differ) else k
            if k < len(seg):
                lower = [seg[k:], child[1], child[2], child[3], child[4] - k]
                child[0], child[1], child[2] = seg[:k], {int(seg[k]): lower}, []
            child[3], child[4] = min(child[3], n), max(child[4], len(rest))
            node, rest = child, rest[k:]
        node[2].append((name, n))

    def similar(self, probe: np.ndarray, num: int = 75) -> list[int]:
        """Names of the sets x with 100 |x & probe| >= num |x | probe|."""
        n = len(probe)
        by_hash = np.argsort(probe)
        ranked = probe[by_hash]
        found, todo = [], [(self.root, 0, 0)]
        while todo:
            (seg, children, ends, least, longest), overlap, used = todo.pop()
            # 100 i >= num (n + m - i), so i >= num (n + m) / (100 + num)
            if (overlap + min(n - used, longest)) * (100 + num) < num * (n + least):
                continue
            if len(seg):
                at = np.minimum(np.searchsorted(ranked, seg), n - 1)
                hit = ranked[at] == seg
                if k := int(np.count_nonzero(hit)):
                    overlap += k
                    used = max(used, int(by_hash[at[hit]].max()) + 1)
            found += [name for name, m in ends if overlap * (100 + num) >= num * (n + m)]
            todo += [(c, overlap, used) for c in children.values()]
        return found


def _ids(pairs: DataFrame) -> DataFrame:
    """id: all ids of a stored table of pairs (a, b), each side made distinct before they meet."""
    return pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()


def _differ(x: str, y: str) -> Column:
    """In how many places two sets' parities differ."""
    # similar sizes have as many bits or twice as many, which fold by halves
    half = F.least(F.size(x), F.size(y))
    folded = [F.when(F.size(c) == half, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), lambda p, q: p.bitwiseXOR(q))) for c in (x, y)]
    return F.aggregate(F.zip_with(*folded, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)


def _folded(bits: str) -> Column:
    """The parities folded to FOLDED longs at most; they differ in no more places than the whole."""
    size = F.least(F.size(bits), F.lit(FOLDED))
    return F.transform(F.sequence(F.lit(0), size - 1), lambda j: F.aggregate(F.filter(bits, lambda _, i: F.pmod(i, size) == j), F.lit(0).cast("long"), lambda t, x: t.bitwiseXOR(x)))


def _close(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, token) but those whose parities differ in more places than similar sets can."""
    asked = _ids(pairs)
    bits = rows.select(F.col("row").alias("id"), "n", "bits").join(asked, "id", "left_semi")
    x, y = (bits.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab")
    # n + m - 2 i >= differ and 7 i >= 3 (n + m)
    return pairs.join(x, "a").join(y, "b").filter(7 * _differ("bitsa", "bitsb") <= F.col("na") + F.col("nb")).select("a", "b", "token")


def _paths(docs: DataFrame, asked: DataFrame, counts, words: int) -> tuple[DataFrame, Broadcast]:
    """id, path (the set in global order) of the rows with an id in asked; the broadcast is to be destroyed once they are used."""
    bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(asked, "id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def needed():
            for b in batches:
                yield b.filter(pa.array(in_filter(bitmap.value, b.column("bit").to_numpy())))

        for b, texts in chunks(needed()):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([_ordered(s, counts.value).tobytes() for s in shingle_sets(texts, words)], pa.binary())], ["id", "path"])

    paths = docs.select(F.col("row").alias("id"), "text", F.pmod(F.xxhash64("row"), F.lit(1 << 22)).alias("bit")).mapInArrow(sets, "id long, path binary")
    return paths.join(asked, "id", "left_semi"), bitmap


def _verified(docs: DataFrame, rows: DataFrame, pairs: DataFrame, counts, words: int) -> DataFrame:
    """Links (u, v) among the pairs (a, b, token), by whole sets: the a that meet at a token form a trie, all their b walk it."""
    pairs = stage(pairs, "pairs")
    pairs = stage(_close(rows, pairs), "close", (pairs,))
    paths, bitmap = _paths(docs, _ids(pairs), counts, words)
    many = pairs.groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > TRIE_SETS).select("token", F.ceil(F.col("c") / TRIE_SETS).alias("blocks"), "c")
    dealt = attach(pairs, many, ["token"], "c", pairs.count())
    dealt = stage(dealt.select("a", "b", "token", F.pmod(F.xxhash64("a"), F.coalesce("blocks", F.lit(1))).cast("int").alias("blk")), "dealt")
    sides = dealt.select("token", "blk", F.col("a").alias("id"), F.lit(False).alias("probe")).unionByName(dealt.select("token", "blk", F.col("b").alias("id"), F.lit(True).alias("probe"))).distinct()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        trie, u, v = Trie(), [], []
        path = [np.frombuffer(x, np.uint64) for x in pdf["path"]]
        for name, x, probe in zip(pdf["id"], path, pdf["probe"]):
            if not probe:
                trie.add(int(name), x)
        for name, x, probe in zip(pdf["id"], path, pdf["probe"]):
            if probe:
                found = trie.similar(x)
                u += found
                v += [int(name)] * len(found)
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    links = stage(sides.join(paths, "id").groupBy("token", "blk").applyInPandas(walk, "u long, v long").filter("u <> v"), "links", (pairs, dealt))
    bitmap.destroy()
    return links


def _enough(na: str, ma: str, pa_: str, nb: str, mb: str, pb: str):
    """Sizes n and places p of the first shingle that two lists of m share (the sets, or what they differ in from a centre) allow the needed overlap."""
    return F.expr(f"4 * least({na}, {nb}) >= 3 * greatest({na}, {nb}) and 7 * ({pa_} + {pb} + abs({ma} - {pa_} - {mb} + {pb})) <= {na} + {nb}")


def _sets(docs: DataFrame, counts, words: int) -> DataFrame:
    """row, doc_id, n, two signatures, prefix, parts of each of its shingles, parities: a row for each of docs (row, doc_id, text)."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = counts.value
        most = HOT_CELL + 8 * int(cells.mean())
        for b, texts in chunks(batches):
            sets = shingle_sets(texts, words)
            sign = [np.array([mix64(s ^ np.uint64(k)).sum(dtype=np.uint64) for s in sets], np.uint64) for k in (0x51ED270B, 0xB492B66F)]
            head = [_ordered(s, cells)[: len(s) - (3 * len(s) + 3) // 4 + 1] if len(s) else s for s in sets]
            offsets = pa.array(np.cumsum([0, *map(len, head)]).astype(np.int32))
            parts = -(-cells[_cells(np.concatenate(head))].astype(np.int64) // most)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _signed(sign[0]), _signed(sign[1]), _lists(head), pa.ListArray.from_arrays(offsets, pa.array(np.maximum(parts, 1).astype(np.int32))), _lists([_parities(s) for s in sets])],
                ["row", "doc_id", "n", "s1", "s2", "head", "parts", "bits"],
            )

    return docs.mapInArrow(prefixes, "row long, doc_id long, n long, s1 long, s2 long, head array<long>, parts array<int>, bits array<long>")


def _best(meetings: DataFrame) -> DataFrame:
    """a, b, token: of each class (id) the two leaders (l) that it meets at most shingles."""
    p = meetings.groupBy(F.col("id").alias("a"), F.col("l.id").alias("b")).agg(F.count("*").alias("k"), F.min("token").alias("token"))
    return p.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("k"), "b"))).filter("k <= 2").select("a", "b", "token")


def _band(n: str) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(4 / 3))).cast("int").alias("band")


def _hot() -> Column:
    """Of rows of _mixed(): their token is to be refined."""
    return F.least("out", "k") > OUTSIDE


def _mixed(met: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """The rows of met at tokens of several components, with their component, the most frequent one of the token (top, that k rows have), how many rows ask there and how many pairs that makes."""
    named = met.join(known, "id", "left").select("token", "id", "n", "m", "pos", "core", "far", "band", F.coalesce("component", "id").alias("comp"))
    sizes = named.groupBy("token", "comp").agg(F.count("*").alias("k"), F.sum(F.col("far").cast("int")).alias("f"))
    tops = sizes.groupBy("token").agg(F.sum("k").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("k", "comp")).alias("t"), F.sum("f").alias("f")).filter("lo <> hi")
    tops = tops.select("token", F.col("t.comp").alias("top"), F.col("t.k").alias("k"), F.ceil(F.col("c") / MEETING).cast("int").alias("split"), F.coalesce("f", F.col("c") - F.col("t.k")).alias("out"), "c")
    return attach(named, tops.withColumn("pairs", F.col("out") * F.col("c")), ["token"], "c", total).filter("top is not null")


def _deltas(docs: DataFrame, pairs: DataFrame, counts, words: int) -> DataFrame:
    """For rows (id, top, center): n, apart (in how many shingles id differs from its centre), near, linked, tokens (the first of those shingles in global order) and core.

    Let D be what x differs in from the centre c. Two texts differ in |D(x) ^ D(y)| shingles, (n + m) / 7 at
    most if they link, so |D(x) & D(y)| is at least |D(x)| - n / 3, and more than (7 |D(y)| - m + |c|) / 14 if x isn't
    linked with c; D without so many of its last ones (core: by the latter) still holds a shared one. Pairs of
    texts that are both linked with c needn't meet.
    """
    many = pairs.groupBy("center").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / TRIE_SETS))
    dealt = stage(attach(pairs, many, ["center"], "c", pairs.count()).select("id", "center", "top", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("blk")), "dealt")
    sides = dealt.withColumn("probe", F.lit(True)).unionByName(dealt.select(F.col("center").alias("id"), "center", "top", "blk", F.lit(False).alias("probe")).distinct())
    paths, bitmap = _paths(docs, _ids(dealt.select(F.col("id").alias("a"), F.col("center").alias("b"))), counts, words)

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        c = np.frombuffer(pdf["path"][~pdf["probe"]].iloc[0], np.uint64)
        out = []
        for name, path in zip(pdf["id"][pdf["probe"]], pdf["path"][pdf["probe"]]):
            x = np.frombuffer(path, np.uint64)
            d = _ordered(np.setxor1d(x, c, assume_unique=True), counts.value)
            near, linked = 7 * len(d) <= 2 * (len(x) + len(c)), 7 * len(d) <= len(x) + len(c)
            core = len(d) - (7 * len(d) - len(x) + len(c)) // 14
            keep = core if linked else max(core, len(x) // 3 + 1)
            out.append((name, len(x), len(d), near, linked, d[: keep if near else 0].view(np.int64), core))
        return pd.DataFrame(out, columns=["id", "n", "apart", "near", "linked", "tokens", "core"]).assign(center=pdf["center"].iloc[0], top=pdf["top"].iloc[0])

    out = stage(sides.join(paths, "id").groupBy("center", "blk").applyInPandas(apart, "id long, n long, apart long, near boolean, linked boolean, tokens array<long>, core long, center long, top long"), "deltas", (dealt,))
    bitmap.destroy()
    return out


def _refined(mixed: DataFrame, deltas: DataFrame) -> DataFrame:
    """Rows to meet instead of mixed's: at its hot tokens only those far from the centre ask, those near it meet each other at what they differ in from it."""
    columns = ["token", "id", "n", "m", "pos", "core", "far", "band"]
    hot = mixed.filter(_hot()).drop("far").join(deltas.select("id", "top", (~F.col("near")).alias("far")), ["id", "top"])
    asked = hot.groupBy("token").agg(F.bool_or("far").alias("asked"), F.count("*").alias("c")).filter("asked")
    hot = attach(hot, asked, ["token"], "c", mixed.count()).filter("asked")
    near = deltas.filter("near").select("id", "n", F.col("apart").alias("m"), F.col("core").alias("first"), "center", F.posexplode("tokens").alias("pos", "d"))
    near = near.select(F.xxhash64("center", "d").alias("token"), "id", "n", "m", "pos", (F.col("pos") < F.col("first")).alias("core"), F.lit(None).cast("boolean").alias("far"), _band("n"))
    own = Window.partitionBy("token")
    near = near.withColumn("c", F.count("*").over(own)).withColumn("any", F.bool_or("core").over(own)).filter("c > 1 and any")
    return mixed.filter(~_hot()).select(columns).unionByName(hot.select(columns)).unionByName(near.select(columns))


def _links(docs: DataFrame, rows: DataFrame, counts, words: int) -> DataFrame:
    """id, component of all classes that link with another; a class is known by the least row of its copies."""
    classes = rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("id"), F.first("head").alias("head"), F.first("parts").alias("parts"))
    met = classes.select("id", "n", "parts", F.posexplode("head").alias("pos", "token"))
    met = met.select("id", "n", "token", "pos", F.get("parts", F.col("pos")).alias("parts")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # who meets nobody that fits goes: by size the next smaller and the next larger one are the likeliest, and of only two both places count
    by_size = Window.partitionBy("token", "part").orderBy("n")
    met = met.select("*", *[f(c, k).over(by_size).alias(f"{c}_{at}{k}") for c, k in (("n", 1), ("pos", 1), ("n", 2)) for f, at in ((F.lag, "b"), (F.lead, "a"))])
    one_of_two = F.when(F.expr("n_b1 is null and n_a2 is null"), _enough("n", "n", "pos", "n_a1", "n_a1", "pos_a1")).when(F.expr("n_a1 is null and n_b2 is null"), _enough("n", "n", "pos", "n_b1", "n_b1", "pos_b1")).otherwise(True)
    met = met.filter("parts > 1 or 4 * n_b1 >= 3 * n or (4 * n >= 3 * n_a1 and 7 * (n - pos) >= 3 * (n + n_a1))").filter((F.col("parts") > 1) | one_of_two)
    met = met.select("id", "n", F.col("n").alias("m"), "token", "pos", "parts", "part")
    # the leader of a token and a range of sizes: rows dealt by token already lie together
    met = met.withColumn("band", _band("n"))
    met = stage(met.withColumn("l", F.min(F.struct("id", "n", "m", "pos")).over(Window.partitionBy("token", "part", "band"))), "met")
    leaders = met.filter("parts > 1").select("token", "band", "l").distinct()
    first = leaders.groupBy("token", "band").agg(F.min("l").alias("f"))
    above = leaders.join(first, ["token", "band"]).select("token", "l.id", "l.n", "l.m", "l.pos", F.col("f").alias("l"))
    stars = met.select("token", "id", "n", "m", "pos", "l").unionByName(above).filter("id <> l.id").filter(_enough("n", "m", "pos", "l.n", "l.m", "l.pos"))
    links = _verified(docs, rows, _best(stars), counts, words)
    known = stage(components(links), "known")

    plain = met.withColumn("core", F.lit(True)).withColumn("far", F.lit(None).cast("boolean"))
    mixed = stage(_mixed(plain, known, met.count()), "mixed", (met,))
    # the centre of a component is the member that most of its hot tokens have
    seats = mixed.filter(_hot() & (F.col("comp") == F.col("top"))).groupBy("top", "id").agg(F.count("*").alias("k"))
    centers = seats.groupBy("top").agg(F.max_by("id", F.struct("k", -F.col("id"))).alias("center"))
    asked = stage(mixed.filter(_hot()).select("id", "top").distinct(), "asked")
    if not asked.isEmpty():
        centers = centers.join(asked.groupBy("top").agg(F.count("*").alias("c")), "top")
        deltas = _deltas(docs, attach(asked, centers, ["top"], "c", asked.count()), counts, words)
        near = deltas.filter("linked and id <> center").select(F.col("center").alias("u"), F.col("id").alias("v"))
        links = stage(links.unionByName(near), "links", (links,))
        known = stage(components(links), "known", (known,))
        refined = stage(_refined(mixed, deltas), "refined", (mixed, deltas))
        mixed = stage(_mixed(refined, known, refined.count()), "mixed", (refined,))
    rows_met, before = mixed.count(), None
    for r in range(ROUNDS + 1):
        left = mixed.groupBy("token").agg(F.first("pairs").alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0))).first()[0]
        if r == ROUNDS or left <= 4 * rows_met or (before is not None and left > WORTH * before):
            break
        before = left
        # while many pairs of components would meet: those outside a token's largest component are held against one member of it, another one each round
        one = mixed.filter("comp = top").groupBy("token", "band").agg(F.min_by(F.struct("id", "n", "m", "pos"), F.xxhash64("id", F.lit(r))).alias("l"), F.count("*").alias("c"))
        ask = attach(mixed.filter("comp <> top and coalesce(far, true)").select("token", "band", "id", "n", "m", "pos"), one, ["token", "band"], "c", mixed.count()).filter("l is not null").filter(_enough("n", "m", "pos", "l.n", "l.m", "l.pos"))
        more = _verified(docs, rows, _best(ask), counts, words)
        links = stage(links.unionByName(more), "links", (links, more))
        known = stage(components(links), "known", (known,))
        # tokens of one component stay such, so only the others are looked at again
        mixed = stage(_mixed(mixed, known, mixed.count()), "mixed", (mixed,))
    mixed = stage(mixed.join(rows.select(F.col("row").alias("id"), _folded("bits").alias("bits")), "id").withColumn("asks", F.coalesce("far", F.col("comp") != F.col("top"))), "mixed", (mixed,))
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "m", "pos", "comp", "core", "asks", "bits")]
    x = mixed.filter("asks").select("token", *side("a"), F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("part"))
    y = mixed.select("token", *side("b"), F.pmod(F.xxhash64("id"), F.col("split")).cast("int").alias("part"))
    meet = F.expr("comp_a <> comp_b and (not asks_b or id_a < id_b) and (core_a or core_b)") & _enough("n_a", "m_a", "pos_a", "n_b", "m_b", "pos_b")
    rest = x.join(y, ["token", "part"]).filter(meet & (7 * _differ("bits_a", "bits_b") <= F.col("n_a") + F.col("n_b"))).groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.min("token").alias("token"))
    more = _verified(docs, rows, rest, counts, words)
    return stage(components(links.unionByName(more)), "linked", (known, mixed, links, more))


def groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """row, doc_id, n_shingles, component_id, group_row for each of docs (row, doc_id, text); group_row is the same for all of a group, and for no other."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = spark.sparkContext.broadcast(shingle_counts(docs, words))
    rows = stage(_sets(docs, counts, words), "sets")
    linked = _links(docs, rows, counts, words)
    r = rows.select("row", "doc_id", "n", "s1", "s2")
    copies = stage(r.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("row").alias("id"), F.min("doc_id").alias("low"), F.count("*").alias("c")).filter("c > 1"), "copies")
    # the least doc_id of each component
    low = linked.join(r.select(F.col("row").alias("id"), "doc_id"), "id").join(copies.select("id", "low"), "id", "left")
    low = low.groupBy("component").agg(F.min(F.coalesce("low", "doc_id")).alias("least"), F.count("*").alias("c"))
    named = stage(attach(linked, low, ["component"], "c", linked.count()), "named", (linked,))
    of_copies = copies.join(named, "id", "left").select("s1", "s2", "n", F.coalesce("component", "id").alias("g"), F.coalesce("least", "low").alias("l"), "c")
    out = attach(r, of_copies, ["s1", "s2", "n"], "c", r.count()).join(named.withColumnRenamed("id", "row"), "row", "left")
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("l", "least", "doc_id").alias("component_id"), F.coalesce("g", "component", "row").alias("group_row"))


def ngram_join(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    return groups(numbered(docs).select("row", "doc_id", "doc.text"), words).select("doc_id", "n_shingles", "component_id")


def first_of_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs, of each group only the one with the smallest doc_id (null last; of equal ones any)."""
    n = numbered(docs)
    g = stage(groups(n.select("row", "doc_id", "doc.text"), words), "groups")
    first = g.groupBy("group_row").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("row"))
    # texts move once, by row; the way of this join doesn't change with the number of ids
    return n.join(first.select("row").hint("merge"), "row", "left_semi").select("doc.*")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))
