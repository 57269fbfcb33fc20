"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names (capitalised words, wherever they stand) and units become typed placeholders, runs of one
placeholder become one, so that a question with other figures or names keeps its template, also if a name
takes two words. Windows of WINDOW canonical words are hash-joined with those of the benchmark; windows
that hit at the same shift belong to one occurrence, and its slots must be filled consistently (one
benchmark value is always replaced by one value). A document is contaminated by an item if COVER of
the item's windows, or a run of RUN windows, occur at one shift.

Items without a usable window (shorter, or nearly all slots) can't be told by their template; theirs are
windows of their plain words, WINDOW or as many as the item has, SHORTEST at least. A shorter item is found only
where a document's words are the item's.

The benchmark's windows are broadcast only while they are at most BROADCAST_BYTES; beyond that both
sides are dealt by hash, windows of texts in PARTS parts each, so that a window that very many texts share
isn't one task's. Either way gives the same rows.

Defined results: null and empty texts and items match nothing; windows with fewer than LITERALS plain
words are not used; repeated rows give their pairs once; rows of one doc_id are read as one document, rows with
null ids are left out here (clean() reads every row by itself); every text under an item_id is an item of its own, told
under that id, and so are items without one; of equally good occurrences the one at the
largest shift is told; a text of any length is read whole; empty tables give no rows; columns besides
doc_id/text and item_id/text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallgrid.llm.common import WORD_SPLIT, documents, numbered, stage

WINDOW = 8
LITERALS, COVER, RUN = 4, 0.5, 14
SHORTEST = 4
BROADCAST_BYTES, PARTS = 32 << 20, 16
# Words of units.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons "
    "ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kmh kph hz khz mhz ghz v volt volts w watt watts kw j joule joules cal kcal dollar dollars cent cents euro euros usd eur % percent degree degrees °c °f"
).split()
EDGE = "[\\p{P}&&[^%]]"


def _words(rows: DataFrame, key: str) -> DataFrame:
    """key, words, bare: a text's words, and those in lower case without outer punctuation."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), f"^{WORD_SPLIT}|{WORD_SPLIT}$", "")
    # one line a word, so that whole texts are lower-cased and stripped at once and words keep their places
    lines = rows.select(F.col(key).cast("long").alias(key), F.regexp_replace(text, WORD_SPLIT, "\n").alias("lines"))
    bare = F.regexp_replace(F.lower("lines"), f"{EDGE}+(?![^\\n])|(?<![^\\n]){EDGE}+", "")
    words = lines.select(key, F.when(F.col("lines") != "", F.split("lines", "\n")).otherwise(F.array().cast("array<string>")).alias("words"), F.split(bare, "\n").alias("bare"))
    return words.select(key, "words", F.slice("bare", 1, F.size("words")).alias("bare"))


def canonical(rows: DataFrame, key: str) -> DataFrame:
    """key, c, raw: a text's canonical words, and the words themselves where a placeholder stands for them (null elsewhere)."""
    kinds = _words(rows, key).select(key, "bare", F.transform("words", lambda w, i: _kind(w, F.get("bare", i))).alias("kinds"))
    # where a word of its own or a run of one placeholder starts
    starts = F.filter(F.sequence(F.lit(0), F.size("kinds")), lambda i: (i == F.size("kinds")) | F.get("kinds", i).isNull() | ~F.get("kinds", i).eqNullSafe(F.get("kinds", i - 1)))
    d = kinds.select(key, "bare", "kinds", starts.alias("at"))
    n = F.size("at") - 1
    first = F.slice("at", 1, n)
    c = F.transform(first, lambda i: F.coalesce(F.get("kinds", i), F.get("bare", i)))
    run = lambda i, j: F.when(F.get("kinds", i).isNotNull(), F.when(j == i + 1, F.get("bare", i)).otherwise(F.array_join(F.slice("bare", i + 1, j - i), " ")))
    return d.select(key, c.alias("c"), F.zip_with(first, F.slice("at", 2, n), run).alias("raw"))


def _kind(w: Column, bare: Column) -> Column:
    """The placeholder of a word, null for plain ones; most words start with a small letter of ASCII and are no number or name."""
    small = (w >= F.lit("a")) & (w < F.lit("{"))
    number = (w >= F.lit("$")) & (w < F.lit(":")) & w.rlike("^[$(+-]*[0-9][0-9.,:/]*%?[.,;:!?)]*$")
    unit = F.when((F.length(w) <= 11) & bare.isin(UNITS), "<unit>")
    low = F.lower(w)
    name = (w != low) & F.when(F.substring(w, 1, 1) != F.substring(low, 1, 1), True).otherwise(w.rlike("^[(\\[{\"']+\\p{Lu}"))
    return F.when(small, unit).when(number, "<num>").otherwise(F.coalesce(unit, F.when(name, "<name>")))


def windows(rows: DataFrame, key: str) -> DataFrame:
    """key, pos, h, slots: a row for each window that has LITERALS plain words; slots are null where all are."""
    d = canonical(rows, key).select(key, "raw", F.transform("c", lambda c: F.xxhash64(c)).alias("g"))
    starts = F.when(F.size("g") >= WINDOW, F.sequence(F.lit(0), F.size("g") - WINDOW))
    d = d.select(key, "raw", "g", F.explode(starts).alias("pos"))
    n = sum(F.get("raw", F.col("pos") + j).isNull().cast("int") for j in range(WINDOW))
    d = d.filter(n >= LITERALS)
    slots = F.when(n < WINDOW, F.slice("raw", F.col("pos") + 1, WINDOW))
    return d.select(key, "pos", F.xxhash64(*(F.get("g", F.col("pos") + j) for j in range(WINDOW))).alias("h"), slots.alias("slots"))


def plain_windows(rows: DataFrame, key: str, size: int, whole: bool) -> DataFrame:
    """key, pos, h, slots (null): windows of size words as they are, or the whole text if it has size words."""
    g = _words(rows, key).select(key, F.transform("bare", lambda c: F.xxhash64(c)).alias("g"))
    g = g.filter(F.size("g") == size) if whole else g.filter(F.size("g") >= size)
    d = g.select(key, "g", F.explode(F.sequence(F.lit(0), F.size("g") - size)).alias("pos"))
    # the size is part of the hash, so that these windows never meet templates
    return d.select(key, "pos", F.xxhash64(F.lit(size), F.lit("plain"), *(F.get("g", F.col("pos") + j) for j in range(size))).alias("h"), F.lit(None).cast("array<string>").alias("slots"))


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, coverage, consistent, contaminated: the best occurrence of each pair that shares a window."""
    # an id may stand for several texts: each is an item of its own
    named = stage(bench.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("item", F.monotonically_increasing_id()), "named")
    items = named.select("item", "text")
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    b = stage(windows(items, "item"), "items")
    left = stage(items.join(b.select(F.col("item").alias("_id")).distinct(), F.col("item") == F.col("_id"), "left_anti"), "left")
    sizes = [r["n"] for r in _words(left, "item").select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).filter("n > 0").distinct().collect()]
    d = windows(docs, "doc_id")
    for n in sorted(sizes):
        # items of just n words, or of WINDOW and more
        mine = left.join(_words(left, "item").filter(F.least(F.size("words"), F.lit(WINDOW)) == n).select(F.col("item").alias("_id")), F.col("item") == F.col("_id"), "left_semi")
        b = b.unionByName(plain_windows(mine, "item", n, n < SHORTEST))
        d = d.unionByName(plain_windows(docs, "doc_id", n, n < SHORTEST))
    b = stage(b.withColumnsRenamed({"pos": "ipos", "slots": "islots"}), "bench")
    sizes = b.groupBy("item").agg(F.count("*").alias("item_windows"))
    d = d.withColumnRenamed("slots", "dslots")
    width = b.agg(F.coalesce(F.sum(40 + F.octet_length(F.coalesce(F.array_join("islots", ",", "-"), F.lit("")))), F.lit(0))).first()[0]
    if width <= BROADCAST_BYTES:
        hit = d.join(F.broadcast(b), "h")
    else:
        every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
        hit = d.withColumn("part", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(PARTS)).cast("int")).join(b.withColumn("part", every), ["h", "part"])
    hit = hit.select("doc_id", "item", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos", F.filter(F.zip_with("islots", "dslots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"].isNotNull()).alias("slots"))
    by = ["doc_id", "item", "shift"]
    # repeated rows hit alike: each place of an occurrence counts once
    hit = stage(hit.groupBy(*by, "ipos").agg(F.first("slots").alias("slots")), "hits")
    w = Window.partitionBy(*by)
    filled = hit.select(*by, F.explode("slots").alias("s")).groupBy(*by, "s.a").agg(F.min("s.b").alias("lo"), F.max("s.b").alias("hi")).groupBy(*by).agg(F.min(F.col("lo") == F.col("hi")).alias("consistent"))
    runs = hit.select(*by, "ipos").withColumn("g", F.col("ipos") - F.row_number().over(w.orderBy("ipos")))
    runs = runs.groupBy(*by, "g").count().groupBy(*by).agg(F.sum("count").alias("n_windows"), F.max("count").alias("run"))
    found = runs.join(filled, by, "left").join(sizes, "item").withColumn("consistent", F.coalesce("consistent", F.lit(True)))
    found = found.withColumn("coverage", F.col("n_windows") / F.col("item_windows"))
    found = found.withColumn("contaminated", F.col("consistent") & ((F.col("coverage") >= COVER) | (F.col("run") >= RUN)))
    best = F.max_by(F.struct("n_windows", "item_windows", "coverage", "consistent", "contaminated"), F.struct("contaminated", "n_windows", "shift"))
    return found.join(named.select("item", "item_id"), "item").groupBy("doc_id", "item_id").agg(best.alias("x")).select("doc_id", "item_id", "x.n_windows", "x.item_windows", F.round("x.coverage", 6).alias("coverage"), "x.consistent", "x.contaminated")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated pairs."""
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated")


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of docs that aren't contaminated, whole; rows that share a doc_id or lack it are rows of their own."""
    n = numbered(docs)
    bad = matches(n.select(F.col("row").alias("doc_id"), "doc.text"), bench).filter("contaminated").select(F.col("doc_id").alias("row")).distinct()
    # a table of known size: it is broadcast as long as it is small, and no text moves
    bad = stage(bad, "contaminated")
    return n.join(bad, "row", "left_anti").select("doc.*")
