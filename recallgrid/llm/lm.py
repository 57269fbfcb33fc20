"""Language-model scoring: counts of all training words, and a log-bilinear model with a vector for every frequent word.

The vocabulary grows with the corpus: the WIDTH * sqrt(tokens) most frequent words (LEAST at least) have
vectors of their own, as words and as contexts. A word is predicted from the two words before it in two
steps, its class (a range of ranks) and the word in the class; both are log-bilinear and trained in
numpy by noise-contrastive estimation on ROUNDS of every EVERY places of all training texts, as many as the
corpus gives. Each task trains on its own share from the same start, and the mean of all tasks' parameters
is the start of the next round, on other places (iterative parameter mixing). Batched matrix products then give the normalised
log-probabilities of all classes, and of all words of the token's class, in each token's context.

Words beyond the vocabulary fall into bands of frequency, which are classes in which a word has its share
by count; a share is left for words never seen. So the probabilities of all words and of the unseen sum
to one in every context. Counts of the COMMON most frequent words are sent to the tasks (a table of
fixed size); the counts of all others meet the texts in a join by hash.

Defined results: null and empty texts are one token, the end; repeated rows are counted and scored each;
a null doc_id is hashed as the empty string; ties of frequency are ranked by hash; texts of any length are
counted and scored whole; without training rows all words are equally unseen; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm.common import chunks, documents, free, hashed_words, mix64, small_batches, stage

FOLDS, HELD_OUT = 7, 2
#: Words whose counts go to the tasks; words with vectors: so many times the root of the tokens, and at least.
COMMON, WIDTH, LEAST = 1 << 18, 0.5, 4096
#: Ranks at which the bands of words without vectors end, as shares of COMMON.
BANDS = (1 / 64, 1 / 16, 1 / 4, 1)
DIM, NOISE, BATCH, RATE, SEED = 24, 32, 2048, 0.04, 7
#: Places are dealt into so many parts by hash; each round trains on one part. Examples that a task holds at a time.
EVERY, ROUNDS, EXAMPLES = 2, 2, 1 << 21
#: Tokens scored at a time.
BLOCK = 1 << 12
#: Distinct words that a task holds before it sends their counts on.
HELD = 1 << 20
END_WORD = np.int64(-0x6A09E667F3BCC909)


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c: how often each word (by hash; the end too) stands in docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list[tuple]) -> pa.RecordBatch:
            h, c = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])

        held, n = [], 0
        for _, texts in chunks(batches):
            h, c = np.unique(hashed_words(texts)[0].view(np.int64), return_counts=True)
            held.append((np.append(h, END_WORD), np.append(c, len(texts))))
            n += len(h)
            if n > 4 * HELD or len(held) > 16:
                held = [_summed(held)]
                n = len(held[0][0])
                if n > HELD:
                    yield send(held)
                    held, n = [], 0
        if held:
            yield send(held)

    return docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _summed(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    return h, np.bincount(at, weights=np.concatenate([x[1] for x in held]), minlength=len(h)).astype(np.int64)


class Lexicon:
    """The common words, sorted by hash, with count, class and unit.

    Units are what a context is made of: a vocabulary word each, then the bands, the rest, the end, the start.
    Classes: ranges of vocabulary words, the bands, the rest, the end; members(k) are the words of class k.
    """

    def __init__(self, top: pd.DataFrame, tokens: int) -> None:
        words = top[top.h != END_WORD].sort_values(["c", "h"], ascending=[False, True])
        h, c = words.h.to_numpy(np.int64)[:COMMON], words.c.to_numpy(np.int64)[:COMMON]
        rank, bands = np.arange(len(h)), len(BANDS)
        self.vocabulary = v = min(len(h), max(LEAST, int(WIDTH * tokens**0.5)))
        self.per_class = max(1, int(np.ceil(v**0.5)))
        self.ranges = k = -(-v // self.per_class)
        band = np.searchsorted(np.array(BANDS) * COMMON, rank, side="right").clip(max=bands - 1)
        unit = np.where(rank < v, rank, v + band)
        cls = np.where(rank < v, rank // self.per_class, k + band)
        self.rest, self.end, self.classes = k + bands, k + bands + 1, k + bands + 2
        self.rest_unit, self.end_unit, self.start_unit, self.units = v + bands, v + bands + 1, v + bands + 2, v + bands + 3
        self.in_class = np.bincount(cls, weights=c, minlength=self.classes)
        order = np.argsort(h)
        self.h, self.c, self.cls, self.unit = h[order], c[order], cls[order].astype(np.int32), unit[order].astype(np.int32)
        self.word_counts = c[:v].astype(float)

    def members(self, k: int) -> slice:
        return slice(k * self.per_class, min(self.vocabulary, (k + 1) * self.per_class))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, and whether it is there."""
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        return at, (self.h[at] == h) if len(self.h) else np.zeros(len(h), bool)


def _places(lex: Lexicon, texts: list[bytes]):
    """Of all tokens with ends: word hash, text's index, class, unit, the units one and two before, place in lex, whether there, whether an end."""
    w, at = hashed_words(texts)
    n = len(w) + len(texts)
    ends = at[1:] + np.arange(len(texts))
    is_end = np.zeros(n, bool)
    is_end[ends] = True
    h = np.empty(n, np.int64)
    h[~is_end], h[is_end] = w.view(np.int64), END_WORD
    place, there = lex.find(h)
    there &= ~is_end
    cls, unit = np.full(n, lex.rest, np.int32), np.full(n, lex.rest_unit, np.int32)
    cls[there], unit[there] = lex.cls[place[there]], lex.unit[place[there]]
    cls[is_end], unit[is_end] = lex.end, lex.end_unit
    text = np.repeat(np.arange(len(texts)), np.diff(at) + 1)
    one, two = np.full(n, lex.start_unit, np.int32), np.full(n, lex.start_unit, np.int32)
    same = text[1:] == text[:-1]
    one[1:][same] = unit[:-1][same]
    same = text[2:] == text[:-2]
    two[2:][same] = unit[:-2][same]
    return h, text, cls, unit, one, two, place, there, is_end


def _sum_rows(i: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct i, and the sums of their rows of x."""
    order = np.argsort(i, kind="stable")
    j = i[order]
    first = np.flatnonzero(np.concatenate(([True], j[1:] != j[:-1])))
    return j[first], np.add.reduceat(x[order], first, axis=0)


class LogBilinear:
    """Score of a class or word x after (two, one): q[x] . (a * r[one] + b * r[two]) + bias[x]."""

    def __init__(self, lex: Lexicon, class_counts: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        f = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        noise = (class_counts + 1) / (class_counts + 1).sum()
        words = (lex.word_counts + 1) / (lex.word_counts + 1).sum() if lex.vocabulary else np.ones(1)
        self.noise = {"c": noise, "w": words}
        self.p = {"r": f(lex.units), "qc": f(lex.classes), "qw": f(len(words)), "bc": np.log(noise).astype(np.float32), "bw": np.log(words).astype(np.float32), "mix": np.stack((np.ones(DIM), np.full(DIM, 0.5))).astype(np.float32)}

    def train(self, one: np.ndarray, two: np.ndarray, cls: np.ndarray, unit: np.ndarray, vocabulary: int, seed: int) -> None:
        """Goes over the examples once, in random order, by stochastic steps of equal scale (Adagrad)."""
        rng, p, n = np.random.default_rng(seed), self.p, len(one)
        if not n:
            return
        g2 = {k: np.full(x.shape, 1e-3, np.float32) for k, x in p.items()}
        cdf = {k: np.cumsum(x) for k, x in self.noise.items()}
        log_noise = {k: np.log(NOISE * x).astype(np.float32) for k, x in self.noise.items()}

        def step(k: str, i, g: np.ndarray) -> None:
            g2[k][i] += g * g
            p[k][i] -= RATE * g / np.sqrt(g2[k][i])

        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            i = order[at : at + BATCH]
            o, t = one[i], two[i]
            r1, r2, mix = p["r"][o], p["r"][t], p["mix"]
            h = r1 * mix[0] + r2 * mix[1]
            dh = np.zeros_like(h)
            for k, target, on in (("c", cls[i], slice(None)), ("w", unit[i], unit[i] < vocabulary)):
                x, hx = target[on], h[on]
                if not len(x):
                    continue
                other = np.minimum(np.searchsorted(cdf[k], rng.random(NOISE) * cdf[k][-1]), len(cdf[k]) - 1)
                q, b = p["q" + k], p["b" + k]
                qx, qn = q[x], q[other]
                gx = 1 / (1 + np.exp(-np.clip(np.einsum("nd,nd->n", hx, qx) + b[x] - log_noise[k][x], -30, 30))) - 1
                gn = 1 / (1 + np.exp(-np.clip(hx @ qn.T + b[other] - log_noise[k][other], -30, 30)))
                dh[on] += gx[:, None] * qx + gn @ qn
                rows = np.concatenate((np.concatenate((gx[:, None] * hx, gx[:, None]), 1), np.concatenate((gn.T @ hx, gn.sum(0)[:, None]), 1)))
                ids, sums = _sum_rows(np.concatenate((x, other)), rows)
                step("q" + k, ids, sums[:, :DIM])
                step("b" + k, ids, sums[:, DIM])
            ids, sums = _sum_rows(np.concatenate((o, t)), np.concatenate((dh * mix[0], dh * mix[1])))
            step("mix", slice(None), np.stack(((dh * r1).sum(0), (dh * r2).sum(0))))
            step("r", ids, sums)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k, x in self.p.items():
            self.p[k] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size

    def log10(self, lex: Lexicon, one: np.ndarray, two: np.ndarray, cls: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """log10 P(class | two, one), times P(word | class, two, one) where the class is one of vocabulary words; normalised."""
        p, n = self.p, len(one)
        out = np.empty(n, np.float32)
        h = p["r"][one] * p["mix"][0] + p["r"][two] * p["mix"][1]
        for at in range(0, n, BLOCK):
            part = slice(at, at + BLOCK)
            out[part] = _chosen(h[part] @ p["qc"].T + p["bc"], cls[part])
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(lex.ranges + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            m = lex.members(k)
            q, b = p["qw"][m].T.copy(), p["bw"][m]
            for at in range(bounds[k], bounds[k + 1], BLOCK):
                i = order[at : min(at + BLOCK, bounds[k + 1])]
                out[i] += _chosen(h[i] @ q + b, unit[i] - m.start)
        return out.astype(float) / np.log(10)


def _chosen(s: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Log of the softmax of each row at k."""
    if s.max() > 80:  # exp would overflow
        s -= s.max(1, keepdims=True)
    at = s[np.arange(len(s)), k]
    return at - np.log(np.exp(s, out=s).sum(1))


def _fit(spark: SparkSession, docs: DataFrame, lex, class_counts: np.ndarray) -> LogBilinear:
    """The model after ROUNDS of parameter mixing over the places of docs; what tasks send is in proportion to the vocabulary."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            h, _, cls, unit, one, two, *_ = _places(lex.value, texts)
            part = (mix64(h.view(np.uint64) ^ mix64(np.arange(len(h), dtype=np.uint64))) % np.uint64(EVERY)).astype(np.int32)
            i = np.flatnonzero(part < ROUNDS)
            yield pa.RecordBatch.from_arrays([pa.array(x[i]) for x in (part, one, two, cls, unit)], ["part", "one", "two", "cls", "unit"])

    examples = stage(docs.select("text").mapInArrow(take, "part int, one int, two int, cls int, unit int"), "examples")
    model = LogBilinear(lex.value, class_counts)
    size, blocks = model.flat().size, 64
    for r in range(ROUNDS):
        start = spark.sparkContext.broadcast(model)

        def train(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
            lx = lex.value
            m = LogBilinear(lx, start.value.noise["c"])
            m.noise = start.value.noise
            m.load(start.value.flat())
            held, n, total = [], 0, 0
            cols = ("one", "two", "cls", "unit")

            def learn() -> None:
                x = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in cols]
                m.train(*x, lx.vocabulary, SEED + r)

            for b in batches:
                held.append(b)
                n += b.num_rows
                if n >= EXAMPLES:
                    learn()
                    total, held, n = total + n, [], 0
            if n:
                learn()
            total += n
            if total:
                parts = np.array_split(m.flat() * np.float32(total), blocks)
                yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([total] * blocks, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "n", "part"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["part"]) / pdf["n"].sum()
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "n": [int(pdf["n"].sum())], "part": [total.astype(np.float32).tobytes()]})

        got = examples.filter(F.col("part") == r).drop("part").mapInArrow(train, "block int, n long, part binary").groupBy("block").applyInPandas(add, "block int, n long, part binary").orderBy("block").collect()
        if got:
            flat = np.concatenate([np.frombuffer(x["part"], np.float32) for x in got])
            assert flat.size == size
            model.load(flat)
        start.destroy()
    free(examples)
    return model


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (_fold(F.col("doc_id")) == HELD_OUT).alias("held_out"))
    train = docs.filter("not held_out")
    counts = stage(word_counts(train), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("h") == int(END_WORD), F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v, ends = total["n"], total["v"], total["ends"]
    # words seen once stay in the rest, from which the model learns what words never seen are like
    lexicon = Lexicon(counts.filter("c > 1").orderBy(F.desc("c"), "h").limit(COMMON + 1).toPandas(), n)
    lex = spark.sparkContext.broadcast(lexicon)
    rest_n, rest_v = n - ends - int(lexicon.c.sum()), v - (ends > 0) - len(lexicon.c)
    class_counts = lexicon.in_class.copy()
    class_counts[lexicon.rest], class_counts[lexicon.end] = rest_n, ends
    model = spark.sparkContext.broadcast(_fit(spark, train, lex, class_counts))
    unit_log, rest_log = np.log10(n + v + 1), np.log10(rest_n + rest_v + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lx, m = lex.value, model.value
        log_c = np.log10(lx.c + 1.0)
        # a word's share of its band; vocabulary words are predicted themselves
        share = np.where(lx.unit < lx.vocabulary, 0.0, np.log10(lx.c / np.maximum(1, lx.in_class)[lx.cls])) if len(lx.c) else np.zeros(0)
        for b, texts in chunks(batches):
            h, text, cls, unit, one, two, place, there, is_end = _places(lx, texts)
            k = len(texts)
            lp = m.log10(lx, one, two, cls, unit)
            base = np.full(len(h), -unit_log)
            base[is_end] += np.log10(ends + 1.0)
            base[there] += log_c[place[there]]
            lp[there] += share[place[there]]
            rare = ~there & ~is_end
            lp[rare] -= rest_log
            order = np.flatnonzero(rare)
            pairs, cnt = np.unique(np.stack((text[order], h[order])), axis=1, return_counts=True) if len(order) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            at = np.searchsorted(pairs[0], np.arange(k + 1)).astype(np.int32)
            known = np.bincount(text, weights=there | (is_end & (ends > 0)), minlength=k).astype(np.int64)
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(np.bincount(text, minlength=k)), pa.array(known), pa.array(np.bincount(text, weights=base, minlength=k)), pa.array(np.bincount(text, weights=lp, minlength=k))]
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (pairs[1], cnt.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*cols, *lists], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "hs", "ns"])

    rows = docs.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, hs array<long>, ns array<long>")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode(F.arrays_zip("hs", "ns")).alias("x")).select("row", F.col("x.hs").alias("h"), F.col("x.ns").alias("k"))
    seen = rare.join(counts, "h").groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("gain"))
    out = rows.drop("hs", "ns").join(seen, "row", "left").na.fill(0, ["more"]).na.fill(0.0, ["gain"])
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base_score") + F.col("gain")).alias("base_score"), (F.col("score") + F.col("gain")).alias("score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
