"""Quality rules with robust multivariate outliers, in DataFrame functions only.

A document's statistics are transformed to a vector (rates smoothed by PRIOR words, so that short texts
don't scatter more); for each language and source a minimum covariance determinant estimate gives a
centre and a scatter matrix: concentration steps run from STARTS starts, and the end of least
determinant counts. Scatter is regularised by a least variance, as most statistics of clean texts are
zero. Vectors beyond the 0.999 quantile of the chi-square law are rejected.

A step is one map-side aggregate: products of the vectors are summed by steps of the distance, and the
steps that hold the nearest KEEP of the rows are added up, so no group is ever gathered or sorted. Rows meet
their group's estimate by attach(), as one group can be a third of all rows. Groups of fewer than
MIN_GROUP rows use the estimate of all rows.

Defined results: null and empty texts have no words and fail the base rule; null lang or source is a
group of its own; repeated rows give repeated result rows; ties at an edge of the distance are kept
together; a text of any length is counted whole; an empty table gives no rows; columns besides doc_id, text,
lang and source are ignored, whatever their names. The verdict never reads doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import WORD_SPLIT, attach, documents, stage

WINDOW = 8  # a power of two
#: Share of rows that a concentration step keeps, starts, steps, and least rows of a group of its own.
KEEP, STARTS, STEPS, MIN_GROUP = 0.75, 3, 5, 60
#: The chi-square law of four dimensions: its 0.999 quantile, and what the scatter of the nearest 0.75 lacks.
CUT, CONSISTENCY = 18.467, 1.4866
#: Least variance in each direction; words of a mean text added to each text.
FLOOR, PRIOR, PRIOR_CHARS = 0.01, 50, 250
#: Distances are counted in so many steps of the logarithm.
BINS = 32
VECTOR = ("v_length", "v_symbols", "v_repeats", "v_upper")
GROUP = ("lang", "source")
ALL = "*"


def statistics(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, lang, source, the counts of the contract and the whole row as doc, one row for each row of docs."""
    names = docs.columns
    keys = [F.col(c).cast("string").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in GROUP]
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, F.coalesce("text", F.lit("")).alias("t"), whole)
    d = d.withColumn("w", F.filter(F.split("t", WORD_SPLIT), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    # a window is known by the hash of its words' hashes; most texts have no window twice
    # (made by doubling: 1, 2, 4, 8 words)
    d = d.withColumn("g", F.transform("w", lambda w: F.xxhash64(w)))
    k = 1
    while k < window:
        size = F.greatest(F.size("g") - k, F.lit(0))
        d = d.withColumn("g", F.zip_with(F.slice("g", 1, size), F.slice("g", k + 1, size), lambda a, b: F.xxhash64(a, b)))
        k *= 2
    d = d.withColumn("u", F.size(F.array_distinct("g")))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return d.select(
        "doc_id", *GROUP, "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col("u") == F.size("g"), F.lit(0)).otherwise(covered(F.col("g"), window)).cast("long").alias("n_repeat_words"),
        F.regexp_count("t", F.lit("\\p{Lu}\\p{Lu}")).cast("long").alias("n_upper_pairs"),
        "doc",
    )


def covered(g: Column, window: int) -> Column:
    """Words in windows whose hash stands twice or more in g."""
    # everything is an argument, evaluated once; a column named inside a lambda would be made anew for each element
    order = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<x:bigint,i:int>"))
    three = F.arrays_zip(order.alias("a"), F.concat(none, order).alias("b"), F.slice(order, 2, F.greatest(F.size(g), F.lit(1))).alias("c"))
    twice = F.transform(F.filter(three, lambda e: (e["a"]["x"] == e["b"]["x"]) | (e["a"]["x"] == e["c"]["x"])), lambda e: e["a"]["i"])
    # places in order; each window adds what the one before it doesn't cover
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    step = lambda a, i: F.struct((a["n"] + i + window - F.greatest(i, a["end"])).cast("int").alias("n"), (i + window).cast("int").alias("end"))
    return F.aggregate(F.array_sort(twice), zero, step, lambda a: a["n"])


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def vectors(stats: DataFrame) -> DataFrame:
    n, c = F.col("n_words") + PRIOR, F.col("word_chars") + PRIOR_CHARS
    return stats.withColumns({
        "v_length": F.log(c / n),
        "v_symbols": F.log1p(20 * F.col("n_symbols") / n),
        "v_repeats": F.log1p(4 * F.col("n_repeat_words") / n),
        "v_upper": F.log1p(20 * F.col("n_upper_pairs") / c),
    })


_P = range(len(VECTOR))
_CELLS = [(i, j) for i in _P for j in range(i + 1)]


def _factor(est: DataFrame, cov) -> DataFrame:
    """est with the Cholesky factor of cov(i, j), regularised, and its determinant's logarithm."""
    for i, j in _CELLS:
        v = cov(i, j) + (FLOOR if i == j else 0.0)
        for k in range(j):
            v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(v, F.lit(FLOOR / 4))) if i == j else v / F.col(f"l{j}{j}"))
    return est.withColumn("logdet", sum(2 * F.log(F.col(f"l{i}{i}")) for i in _P))


def _distance(d: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    total = F.lit(0.0)
    for i in _P:
        z = F.col(VECTOR[i]) - F.col(f"mu{i}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        d = d.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return d.withColumn("d2", total)


def _starts(rows: DataFrame) -> DataFrame:
    """g, start, c, centre and factor: medians with the scale of the quantiles, mean and covariance, medians with equal scales."""
    agg = [F.count("*").alias("c")]
    for i, v in enumerate(VECTOR):
        agg += [F.percentile_approx(v, [0.15, 0.5, 0.85], 1000).alias(f"r{i}"), F.avg(v).alias(f"a{i}")]
    agg += [(F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])) / F.count("*")).alias(f"q{i}{j}") for i, j in _CELLS]
    one = rows.groupBy("g").agg(*agg).withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    one = one.withColumns({f"mu{i}": F.when(F.col("start") == 1, F.col(f"a{i}")).otherwise(F.col(f"r{i}")[1]) for i in _P})

    def cov(i: int, j: int) -> Column:
        spread = F.pow((F.col(f"r{i}")[2] - F.col(f"r{i}")[0]) / 2, 2) if i == j else F.lit(0.0)
        return F.when(F.col("start") == 0, spread).when(F.col("start") == 1, F.col(f"q{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")).otherwise(0.0)

    return _factor(one, cov).select("g", "start", "c", *[f"mu{i}" for i in _P], *[f"l{i}{j}" for i, j in _CELLS])


def _concentrated(rows: DataFrame, est: DataFrame, total: int) -> DataFrame:
    """One step: centre and factor of the rows nearest to each estimate; rows: g and the vector."""
    cells = [c for c in est.columns if c not in ("g", "start", "c")]
    of_group = est.groupBy("g").agg(F.max("c").alias("c"), F.collect_list(F.struct("start", *cells)).alias("ests"))
    far = attach(rows, of_group, ["g"], "c", total).select("g", *VECTOR, F.inline("ests"))
    far = _distance(far).withColumn("bin", F.floor(BINS * F.log2(1 + F.col("d2"))).cast("int"))
    sums = [F.count("*").alias("m")] + [F.sum(VECTOR[i]).alias(f"s{i}") for i in _P] + [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}{j}") for i, j in _CELLS]
    bins = far.groupBy("g", "start", "bin").agg(*sums)
    w = Window.partitionBy("g", "start")
    below = F.coalesce(F.sum("m").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("below", below).withColumn("c", F.sum("m").over(w)).filter(F.col("below") < KEEP * F.col("c"))
    out = bins.groupBy("g", "start", "c").agg(*[F.sum(x).alias(x) for x in bins.columns if x[0] in "msq" and x != "start"])
    out = out.withColumns({f"mu{i}": F.col(f"s{i}") / F.col("m") for i in _P})
    return _factor(out, lambda i, j: CONSISTENCY * (F.col(f"q{i}{j}") / F.col("m") - F.col(f"mu{i}") * F.col(f"mu{j}"))).select(*est.columns, "logdet")


def mcd(rows: DataFrame) -> DataFrame:
    """g, c, centre mu0.. and factor l00.. of each group g of rows (g and the columns of VECTOR): of all starts the end of least determinant."""
    est, total = stage(_starts(rows), "starts"), rows.count()
    for _ in range(STEPS):
        est = stage(_concentrated(rows, est.drop("logdet"), total), "mcd", (est,))
    best = F.min_by(F.struct(*[x for x in est.columns if x not in ("g", "start", "c")]), F.struct("logdet", "start"))
    return est.groupBy("g", "c").agg(best.alias("x")).select("g", "c", "x.*")


def verdicts(stats: DataFrame) -> DataFrame:
    """base_failed, kept and d2 added to statistics()."""
    key = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in GROUP])
    rows = stage(vectors(stats).withColumn("base_failed", base_failed()).withColumn("g", key), "quality")
    good = rows.filter("not base_failed").select(F.explode(F.array("g", F.lit(ALL))).alias("g"), *VECTOR)
    est = stage(mcd(good), "estimates")
    cells = [c for c in est.columns if c not in ("g", "c", "logdet")]
    every = est.filter(F.col("g") == ALL).first()
    sizes = rows.groupBy("g").agg(F.count("*").alias("n_rows"))
    own = est.filter((F.col("g") != ALL) & (F.col("c") >= MIN_GROUP)).drop("c", "logdet").join(sizes, "g")
    d = attach(rows, own, ["g"], "n_rows", rows.count())
    d = _distance(d.withColumns({c: F.coalesce(c, F.lit(every[c] if every else None).cast("double")) for c in cells}))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUT)
    return d.select(*stats.columns, "base_failed", kept.alias("kept"), F.round("d2", 6).alias("d2"))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, whole."""
    return verdicts(statistics(docs)).filter("kept").select("doc.*")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2 for each row of docs."""
    return verdicts(statistics(docs).drop("doc")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
