"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own embedding (of a vocabulary learned from the training texts) and as the mean
of the embeddings of its character trigrams. Windows of WINDOW words, every STRIDE words, run through a
forward and a backward GRU; attention pools the states, and a logistic unit scores the window. A text's
score is the highest of all its windows.

Labels belong to texts, not windows. Training starts from all windows of toxic texts, each with its share
of the text's weight, against random windows of clean texts; no word statistics by label are used. Then it
takes, of each toxic text, the windows that the network itself scores highest, if they stand out above
what it gives to clean texts, and the windows of clean texts that it scores highest.
The classifier is fitted on at most TOXIC + CLEAN labelled rows of at most FIT_BYTES (FIT_TOTAL together), picked by the hash of
doc_id, in whose texts all windows (toxic) or CLEAN_WINDOWS random ones (clean) are used; every text is
scored whole, whatever its length.

Defined results: null, empty and wordless texts score 0; a training set without both labels gives 0 to
all; repeated rows score alike, and a doc_id with several labels counts as toxic if one is; ties of score
change nothing; a null doc_id hashes as the empty string; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import chunks, documents, prefix_hash, small_batches, span_hash

FOLDS, HELD_OUT = 5, 0
WINDOW, STRIDE = 32, 16
TOXIC, CLEAN, CLEAN_WINDOWS, FIT_BYTES, FIT_TOTAL = 800, 2000, 3, 200_000, 32 << 20
VOCABULARY, TRIGRAMS, D_WORD, D_CHAR, HIDDEN = 20000, 4096, 12, 8, 8
EPOCHS, BATCH, RATE, DECAY, SEED = 9, 512, 0.02, 0.1, 11
#: Steps of training at least.
STEPS = 120
#: Texts, and share of all texts, that must hold a word before it is in the vocabulary.
LEAST, LEAST_SHARE = 4, 1 / 400
#: Windows scored at a time.
BLOCK = 4096

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


class Words:
    """Words (runs of letters and digits, lower case) of texts: hashes, distinct ones, trigrams of the distinct."""

    def __init__(self, texts: list[bytes]) -> None:
        u = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        inside = np.zeros(len(u) + 2, np.int8)
        inside[1:-1] = _INSIDE[u]
        d = np.diff(inside)
        s, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        c, inv = prefix_hash(u)
        self.hash, first, self.of = np.unique(span_hash(c, inv, s, e), return_index=True, return_inverse=True)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.at = np.concatenate(([0], np.searchsorted(s, ends)))
        # trigrams over each distinct word with a sign at either end
        ws, we = s[first], e[first]
        n = we - ws
        start = np.concatenate(([0], np.cumsum(n)))
        self.word = np.repeat(np.arange(len(n)), n)
        place = ws[self.word] + np.arange(start[-1]) - start[self.word]
        x = u.astype(np.uint32)
        left = np.where(place > ws[self.word], x[place - 1], 1)
        right = np.where(place + 1 < we[self.word], x[np.minimum(place + 1, len(x) - 1)], 2)
        self.tri = (((left * 8191 + x[place]) * 8191 + right) * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64) % TRIGRAMS
        self.length = np.maximum(n, 1)


def window_starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, text's index and length of each window; the last ends with the text."""
    n = np.diff(at)
    k = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), k)
    i = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
    first = at[text] + np.minimum(i * STRIDE, np.maximum(0, n[text] - WINDOW))
    return first, text, np.minimum(WINDOW, n[text])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, vocabulary: np.ndarray) -> None:
        """vocabulary: sorted word hashes."""
        rng = np.random.default_rng(SEED)
        f = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        d, h = D_WORD + D_CHAR, HIDDEN
        self.vocabulary = vocabulary
        self.p = {"word": rng.normal(0, 0.1, (len(vocabulary) + 1, D_WORD)).astype(np.float32), "char": rng.normal(0, 0.1, (TRIGRAMS, D_CHAR)).astype(np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": f(d, 3 * h), f"U{side}": f(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": f(2 * h, h), "a": np.zeros(h, np.float32), "v": f(h, 1)[:, 0], "o": f(2 * h, 1)[:, 0], "z": np.full(1, -2, np.float32)}

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, w: Words) -> np.ndarray:
        """A row for each distinct word."""
        c = np.stack([np.bincount(w.word, weights=self.p["char"][w.tri, j], minlength=len(w.hash)) for j in range(D_CHAR)], 1) / w.length[:, None]
        return np.concatenate((self.p["word"][self.ids(w.hash)], c.astype(np.float32)), 1)

    def forward(self, x: dict[str, np.ndarray], mask: np.ndarray | None, keep: bool = False):
        """x: projected inputs (time, windows, 3 hidden) of either side; logits, and what backward needs."""
        p, h, (t, n, _) = self.p, HIDDEN, x["f"].shape
        states, tape = np.empty((t, n, 2 * h), np.float32), {}
        for side, off in (("f", 0), ("b", h)):
            s, steps = np.zeros((n, h), np.float32), []
            for k in range(t) if side == "f" else range(t - 1, -1, -1):
                u = s @ p[f"U{side}"]
                g = _sigmoid(x[side][k, :, : 2 * h] + u[:, : 2 * h])
                z, r = g[:, :h], g[:, h:]
                m = np.tanh(x[side][k, :, 2 * h :] + r * u[:, 2 * h :])
                new = s + z * (m - s)
                if mask is not None:
                    new = np.where(mask[k][:, None], new, s)
                if keep:
                    steps.append((k, s, u[:, 2 * h :], z, r, m))
                s = new
                states[k, :, off : off + h] = s
            tape[side] = steps
        e = np.tanh(states @ p["A"] + p["a"])
        score = e @ p["v"]
        if mask is not None:
            score = np.where(mask, score, -1e9)
        score = np.exp(score - score.max(0))
        w = score / score.sum(0)
        pooled = np.einsum("tn,tnd->nd", w, states)
        return pooled @ p["o"] + p["z"][0], (states, tape, e, w, pooled)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: (x @ self.p[f"W{s}"] + self.p[f"c{s}"]).astype(np.float32) for s in "fb"}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of the weighted log loss: by parameter, and by input x (time, windows, d)."""
        p, h = self.p, HIDDEN
        logit, (states, tape, e, w, pooled) = self.forward(self.project(x), mask, True)
        d = ((_sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        g = {"o": pooled.T @ d, "z": d.sum(keepdims=True)}
        dp = d[:, None] * p["o"]
        dw = np.einsum("nd,tnd->tn", dp, states)
        ds = w * (dw - (w * dw).sum(0))
        de = ds[:, :, None] * p["v"] * (1 - e * e)
        g |= {"v": np.einsum("tn,tnh->h", ds, e), "A": np.einsum("tnd,tnh->dh", states, de), "a": de.sum((0, 1))}
        dst = w[:, :, None] * dp + de @ p["A"].T
        dx = np.zeros_like(x)
        for side, off in (("f", 0), ("b", h)):
            U, W = p[f"U{side}"], p[f"W{side}"]
            gU, gW, gc = np.zeros_like(U), np.zeros_like(W), np.zeros(3 * h, np.float32)
            back = np.zeros((x.shape[1], h), np.float32)
            for k, s, um, z, r, m in reversed(tape[side]):
                back = back + dst[k, :, off : off + h]
                on = back * mask[k][:, None]
                dm = on * z * (1 - m * m)
                da = np.concatenate((on * (m - s) * z * (1 - z), dm * um * r * (1 - r), dm), 1)
                du = np.concatenate((da[:, : 2 * h], dm * r), 1)
                gU += s.T @ du
                gW += x[k].T @ da
                gc += da.sum(0)
                dx[k] += da @ W.T
                back = back - on + on * (1 - z) + du @ U.T
            g |= {f"U{side}": gU, f"W{side}": gW, f"c{side}": gc}
        return g, dx

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Logit of each text: the highest of its windows; -inf without words."""
        out = np.full(len(texts), -np.inf)
        w = Words(texts)
        if not len(w.of):
            return out
        x = self.project(self.inputs(w))
        first, text, n = window_starts(w.at)
        for part in (np.flatnonzero(n == WINDOW), np.flatnonzero(n < WINDOW)):
            for k in range(0, len(part), BLOCK):
                i = part[k : k + BLOCK]
                span = first[i] + np.arange(WINDOW)[:, None]
                mask = None if n[i[0]] == WINDOW else np.arange(WINDOW)[:, None] < n[i]
                at = w.of[np.minimum(span, len(w.of) - 1)]
                np.maximum.at(out, text[i], self.forward({s: v[at] for s, v in x.items()}, mask)[0])
        return out


def train(texts: list[bytes], toxic: np.ndarray) -> Network | None:
    """A network for texts with labels (0, 1); None without both labels. A fifth of them sets where 0.5 lies."""
    if not 0 < toxic.sum() < len(toxic):
        return None
    aside = np.arange(len(texts)) % 5 == 4
    if not (0 < toxic[aside].sum() < aside.sum() and 0 < toxic[~aside].sum() < (~aside).sum()):
        return _train(texts, toxic)
    net = _train([t for t, x in zip(texts, aside) if not x], toxic[~aside])
    s = np.clip(net.scores([t for t, x in zip(texts, aside) if x]), -30, 30)
    cuts = np.sort(s)
    cuts = (cuts[1:] + cuts[:-1]) / 2
    # rightly found less wrongly found; the middle of the best cuts
    gain = np.array([((s > c) * np.where(toxic[aside] == 1, 1, -1)).sum() for c in cuts])
    net.p["z"] -= np.float32(cuts[gain == gain.max()].mean())
    return net


def _train(texts: list[bytes], toxic: np.ndarray) -> Network:
    rng, w = np.random.default_rng(SEED), Words(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(w.at))
    seen = np.unique(np.stack((w.of, text_of)), axis=1)
    count = np.bincount(seen[0], minlength=len(w.hash))
    known = np.sort(np.lexsort((w.hash, -count))[:VOCABULARY])
    known = known[count[known] >= max(LEAST, LEAST_SHARE * len(texts))]
    net = Network(w.hash[known])
    ids, first_tri = net.ids(w.hash), np.searchsorted(w.word, np.arange(len(w.hash) + 1))
    first, text, n = window_starts(w.at)
    span = np.minimum(first + np.arange(WINDOW)[:, None], len(w.of) - 1)
    inside = np.arange(WINDOW)[:, None] < n
    is_toxic = toxic[text] == 1
    positive = np.flatnonzero(is_toxic)
    per_text = np.bincount(text, minlength=len(texts))
    clean = np.flatnonzero(~is_toxic)
    pick = rng.random(len(clean))
    order = np.lexsort((pick, text[clean]))
    clean = clean[order]
    rank = np.arange(len(clean)) - np.searchsorted(text[clean], text[clean])
    clean = clean[rank < CLEAN_WINDOWS]
    hard = clean[:0]
    m, v, step = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}, 0
    epochs = max(EPOCHS, STEPS * BATCH // max(1, len(clean)))
    phase = 0
    for epoch in range(epochs):
        if epoch and epoch % (epochs // 3) == 0:  # the windows that the network takes for the reason of the label
            x = net.project(net.inputs(w))
            parts = np.array_split(np.arange(len(text)), max(1, len(text) // BLOCK))
            s = np.concatenate([net.forward({k: a[w.of[span[:, i]]] for k, a in x.items()}, inside[:, i])[0] for i in parts])
            high = np.full(len(texts), -np.inf)
            np.maximum.at(high, text, s)
            # texts in which nothing stands out above clean ones stay out: their labels can't be learned from
            usual = np.quantile(high[(toxic == 0) & (high > -np.inf)], 0.9) if (high[toxic == 0] > -np.inf).any() else 0.0
            positive = np.flatnonzero(is_toxic & (s >= high[text] - 1) & (high[text] > usual))
            phase += 1
            # and those that it takes wrongly
            hard = np.flatnonzero(~is_toxic & (s == high[text]) & (s > -2))
        if not len(positive):
            break
        every = np.concatenate((positive, clean, hard, hard))
        # a toxic text weighs the same whatever its length, toxic ones together 0.3 of the clean
        share = np.where(toxic[text[every]] == 1, 1 / (per_text[text[every]] if phase == 0 else 1), 1.0)
        bad = toxic[text[every]] == 1
        share[bad] *= max(1.0, 0.3 * len(clean) / share[bad].sum()) if phase == 0 else max(1.0, 0.3 * len(clean) / len(positive))
        for i in np.array_split(rng.permutation(len(every)), max(1, len(every) // BATCH)):
            k, step = every[i], step + 1
            mask, at = inside[:, k], w.of[span[:, k]]
            used, of = np.unique(at, return_inverse=True)
            size = first_tri[used + 1] - first_tri[used]
            of_word = np.repeat(np.arange(len(used)), size)
            tri = np.arange(size.sum()) + np.repeat(first_tri[used] - np.cumsum(size) + size, size)
            chars = np.stack([np.bincount(of_word, weights=net.p["char"][w.tri[tri], j], minlength=len(used)) for j in range(D_CHAR)], 1) / w.length[used, None]
            x = np.concatenate((net.p["word"][ids[used]], chars.astype(np.float32)), 1)
            g, dx = net.gradients(x[of.reshape(at.shape)], mask, toxic[text[k]].astype(np.float32), share[i])
            du = np.zeros((len(used), D_WORD + D_CHAR), np.float32)
            np.add.at(du, of.ravel(), dx.reshape(-1, D_WORD + D_CHAR))
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], ids[used], du[:, :D_WORD])
            np.add.at(g["char"], w.tri[tri], (du[:, D_WORD:] / w.length[used, None])[of_word])
            for q, a in g.items():
                m[q] += 0.1 * (a - m[q])
                v[q] += 0.01 * (a * a - v[q])
                net.p[q] -= RATE * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.99**step)) + 1e-7)
                if q in ("word", "char"):
                    net.p[q] *= 1 - RATE * (DECAY if q == "word" else 3 * DECAY)
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """On at most TOXIC + CLEAN labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("y")).filter("y in (0, 1)").filter(_fold(F.col("_id")) != HELD_OUT)
    known = known.groupBy("_id").agg(F.max("y").alias("y"))
    some = known.filter("y = 1").orderBy(F.xxhash64("_id"), "_id").limit(TOXIC).unionByName(known.filter("y = 0").orderBy(F.xxhash64("_id"), "_id").limit(CLEAN))
    text = F.coalesce("text", F.lit(""))
    # of several texts under one id the least; of each label as many as fit into half of FIT_TOTAL, in the order of the hash
    rows = docs.filter(F.octet_length(text) <= FIT_BYTES).join(F.broadcast(some), docs["doc_id"] == F.col("_id")).groupBy("_id", "y").agg(F.min(text).alias("text"))
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy("y").orderBy(F.xxhash64("_id"), "_id"))
    rows = rows.withColumn("_b", so_far).filter(F.col("_b") <= FIT_TOTAL // 2).orderBy("_id").collect()
    return train([r["text"].encode() for r in rows], np.array([r["y"] for r in rows], np.int64))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text); labels: doc_id, toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (_fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    net = spark.sparkContext.broadcast(fit(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in chunks(batches):
            s = _sigmoid(net.value.scores(texts)) if net.value else np.zeros(len(texts))
            s = np.where(s < 1e-12, 0.0, s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
