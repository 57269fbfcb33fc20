"""Results that differed from the SQL on odd or larger tables."""

import duckdb


def test_now_pages_keep_a_last_line_end(spark, tmp_path):
    """The cut may end in a line end, which the SQL keeps: only spaces are trimmed. A conversation without a text has no page."""
    from recallgrid import catalog

    text = [(1, 0, "a" * 699), (1, 1, "b"), (2, 0, " x "), (2, 1, ""), (3, 0, None), (4, 0, None), (4, 1, "y")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in text], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, catalog.queries()["now_pages"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(duck.sql(catalog.oracle_sql()["now_pages"]).fetchall())
    assert got[0][1] == "a" * 699 + "\n" and got[2] == (3, None)


def test_now_pages_hold_whole_conversations(spark, tmp_path):
    """A page isn't cut: not after 700 characters or 1,500 bytes, nor after twelve lines."""
    from recallgrid import catalog

    text = [(1, k, f" {'abcdefghij'[k % 10] * 90} 7") for k in range(40)] + [(2, 0, "x" * 5000), (3, 0, "a\n" * 30 + "b ")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in text], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, catalog.queries()["now_pages"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(duck.sql(catalog.oracle_sql()["now_pages"]).fetchall())
    assert got[0][1].count("\n") == 39 and len(got[1][1]) == 5000 and got[2][1] == "a\n" * 30 + "b"


def test_rewritten_rows_are_upper_case_in_all_letters(spark, tmp_path):
    """Not only ASCII letters: each letter has its one-letter upper case, as in the SQL."""
    from pyspark.sql import functions as F

    from recallgrid import catalog
    from recallgrid.functions import text as T

    texts = ["straße été Ñandú", "ﬁn ᾳ ΐ ŉ", "", "ÀÉ ſı i̇"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "t string").select(T.upper(F.col("t"))).collect()]
    duck = duckdb.connect()
    assert got == [duck.sql(f"SELECT upper('{x}')").fetchall()[0][0] for x in texts]
    assert got[0] == "STRAẞE ÉTÉ ÑANDÚ"
    assert "upper(left(content, 40))" in catalog.oracle_sql()["rewrite_layer"]


def test_every_text_is_searched_for_signs():
    """A sign word in letters that only the pattern's own folding of case knows was passed over before the search."""
    from recallgrid.llm.pii import dots, find_pii, signed

    text = "write to bob at mail poınt com today"
    assert signed(text) and len(dots(text)) == 1
    assert find_pii(text)[5] == find_pii(text.replace("ı", "i"))[5] != ""


def test_rows_of_small_groups_travel_once(spark, monkeypatch):
    """A group that fits a block is dealt whole: no row is sent to several cells, and nothing is stored but the list of larger groups."""
    import numpy as np

    from recallgrid.operators import cluster

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, f"u{i // 50}", rng.normal(size=8).tolist()) for i in range(600)], "id long, user_id string, embedding array<double>")
    dealt, stored = [], []
    meet, saved = cluster.meet, cluster.saved
    monkeypatch.setattr(cluster, "meet", lambda rows, *a, **k: (dealt.append(rows.count()), meet(rows, *a, **k))[1])
    monkeypatch.setattr(cluster, "saved", lambda df, name: (stored.append(name), saved(df, name))[1])
    assert cluster.similar_pairs(df, 0.5).count() > 100
    assert dealt == [600] and stored == ["large"]


def test_terms_are_counted_in_their_row(spark, tmp_path):
    """No hash table of all terms of a task: the plan of the postings has one shuffle (the sort) and no aggregate; counts are those of the words."""
    from collections import Counter

    from pyspark.sql import functions as F

    from recallgrid.sources import index

    texts = [(i, f"u{i % 3}", " ".join(f"w{(i * j) % 7}" for j in range(i % 11))) for i in range(700)] + [(700, "u0", None)]
    rows = spark.createDataFrame(texts, "id long, owner string, t string")
    terms = F.filter(F.split("t", " "), lambda w: w != "")
    index.write_postings(rows, terms, str(tmp_path / "x"))
    got = {(r["owner"], r["term"], r["id"]): (r["tf"], r["dl"]) for r in spark.read.parquet(str(tmp_path / "x" / "postings")).collect()}
    want = {(u, w, i): (n, len((t or "").split())) for i, u, t in texts for w, n in Counter((t or "").split()).items()}
    assert got == want
    assert callable(index.counted)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_word_has_one_term_in_both_forms(spark):
    """The index makes terms of different words only; its rule is that of the column expression."""
    import random
    import string

    from recallgrid.functions import text as T

    rng = random.Random(3)
    ends = ["", "s", "ss", "us", "is", "es", "sses", "xes", "ches", "shes", "ies", "ing", "ed", "pped", "lled", "nning", "aaed", "2s", "és"]
    words = [*T.STOPWORDS, *T.IRREGULAR, *ends, *("".join(rng.choices(string.ascii_lowercase + "é3", k=rng.randint(1, 6))) + rng.choice(ends) for _ in range(4000))]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "t string").select(T.tokens("t")).collect()]
    assert got == [[t] if (t := T.term(w)) is not None else [] for w in words]


def test_index_reads_texts_once_and_grows_in_partitions(spark, tmp_path):
    """Sizes are summed from the postings; the number of partitions follows the bytes of input, so a task sorts no more of a larger table."""
    from pyspark.sql import functions as F

    from recallgrid.functions import text as T
    from recallgrid.sources import index

    read = spark.sparkContext.accumulator(0)

    def seen(t):
        read.add(1)
        return t

    texts = [(i, f"u{i % 3}", f"Words tested {i}, the words") for i in range(90)] + [(90, "u3", None), (91, "u3", "the a")]
    rows = spark.createDataFrame(texts, "id long, owner string, t string").withColumn("t", F.udf(seen, "string").asNondeterministic()("t"))
    index.write_postings(rows, F.lower("t"), str(tmp_path / "x"), T.term, 9 * index.SHARE)
    assert read.value == len(texts)
    assert len(list((tmp_path / "x" / "postings").glob("*.parquet"))) > 4
    got = {(r["owner"], r["term"], r["id"]): (r["tf"], r["dl"]) for r in spark.read.parquet(str(tmp_path / "x" / "postings")).collect()}
    assert got == {(f"u{i % 3}", w, i): (n, 4) for i in range(90) for w, n in (("word", 2), ("test", 1), (str(i), 1)) if len(w) > 1} | {(f"u{i % 3}", w, i): (n, 3) for i in range(10) for w, n in (("word", 2), ("test", 1))}
    sizes = {r["owner"]: (r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "x" / "sizes")).collect()}
    assert sizes["u3"] == (2, 0) and sum(n for n, _ in sizes.values()) == 92 and sum(t for _, t in sizes.values()) == 80 * 4 + 10 * 3


def test_keyword_lists_are_cut_in_each_task(spark):
    """A query's rows aren't sorted in one task: each task passes on its first k; and no row is shuffled to count a term's rows."""
    from recallgrid.operators import rank as R

    terms = spark.createDataFrame([(q, "u", t) for q in range(3) for t in ("a", "b")], "query_id long, owner string, term string")
    postings = spark.createDataFrame([("u", t, i, 1 + i % 3, 9) for t in ("a", "b") for i in range(40)], "owner string, term string, id long, tf long, dl long")
    sizes = spark.createDataFrame([("u", 50, 450)], "owner string, n long, total long")
    df = R.bm25(terms, postings, sizes, 5)
    assert "WindowGroupLimit" in plan(df) and plan(df).count("windowspecdefinition(") == 1
    assert sorted((r["query_id"], r["kpos"], r["id"]) for r in df.collect()) == [(q, k, i) for q in range(3) for k, i in enumerate((2, 5, 8, 11, 14))]


def test_found_rows_are_looked_up_before_tables_meet(spark, sf):
    """Of memory rows by id, every table is cut to the ids first: no text that isn't asked for is shuffled."""
    from recallgrid import fixtures as X

    ids = spark.createDataFrame([(3,), (7,), (3,), (999999,)], "id long")
    some = X.mem(spark, sf, True, ids)
    assert plan(some).count("LeftSemi") == 3
    want = {r["id"]: r for r in X.mem(spark, sf, True).filter("id in (3, 7)").collect()}
    assert {r["id"]: r for r in some.collect()} == want and len(want) == 2


def test_sources_to_remove_are_named_once(spark):
    """What gives the list of sources runs once, however often the list is read; the result is the same beyond the number that is broadcast."""
    from pyspark.sql import functions as F

    from recallgrid.operators import graph as G

    read = spark.sparkContext.accumulator(0)

    def seen(s):
        read.add(1)
        return s

    edges = spark.createDataFrame([("", "a", "r", "b", [1, 2]), ("", "a", "r", "c", [2]), ("o", "a", "r", "b", [])], "owner string, src string, relation string, dst string, sources array<long>")
    gone = spark.createDataFrame([(2,), (2,), (5,)], "s long").select(F.udf(seen, "long").asNondeterministic()("s").alias("s"))
    assert sorted(map(tuple, G.remove_sources(edges, gone).collect())) == [("", "a", "r", "b", [1]), ("o", "a", "r", "b", [])]
    assert read.value == 3


def test_first_identifier_is_found_in_the_text(spark):
    """One search of the text, not a look at each word with and without its outer punctuation; the same word."""
    from pyspark.sql import functions as F

    from recallgrid.functions import text as T

    def old(word):
        w = F.regexp_replace(word, "^[.,;:!?\"'()\\[\\]{}]+|[.,;:!?\"'()\\[\\]{}]+$", "")
        return w.rlike("[\\p{Nd}_]") | w.rlike("[\\p{L}\\p{Nd}][^\\p{L}\\p{Nd}\\s'’][\\p{L}\\p{Nd}]")

    texts = ["plain words, (only) it's o’clock", "a -b- c-d 'e-f'", "x (x_y), 7.", "7. v2!", "_", " ._ ", ".a-.\n a.b,\n x", "😀 😀😀x--y x-😀 a😀b c", "٣ ", "a\n1 b", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.first_identifier(F.col("t")).alias("first"), F.get(F.filter(F.split("t", " "), old), F.lit(0)).alias("old"))
    got = df.collect()
    assert [r["first"] for r in got] == [r["old"] for r in got]
    assert [r["first"] for r in got][:5] == [None, "c-d", "(x_y),", "7.", "_"]


def test_restatements_of_small_groups_are_walked_where_they_are_dealt(spark, monkeypatch):
    """No pair and no vector is shuffled or stored: only what is restated leaves the task. Groups of any size give the walk's rows, with vectors held or named."""
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from recallgrid.operators import cluster
    from recallgrid.operators import graph as G

    rng, own = random.Random(4), np.random.default_rng(4).normal(size=(50, 8))
    heads = {t: x.tolist() for t, x in enumerate(np.random.default_rng(5).normal(size=(4, 8)))}
    rows = [(i * 7 % 401, f"u{i % 3}", "a" if i % 3 else None, rng.choice(["P1", "p1 v2", "p2", "p1 x", "é1", None]), rng.choice(["is_in", "has"]), rng.choice(["s1", "S1 b", "3"]), rng.random() < 0.7, rng.randrange(52), rng.randrange(4), rng.choice([0.1, 0.3, 0.7])) for i in range(240)]
    docs = spark.createDataFrame(rows, "id long, user_id string, agent_id string, src string, relation string, dst string, fresh boolean, v long, t long, w double").repartition(3)
    named = cluster.Named(spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(own)], "v long, embedding array<float>"), heads)
    stored, saved = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df, name: (stored.append((name, plan(df))), saved(df, name))[1])

    def got(d, **k):
        stored.clear()
        return sorted(map(tuple, G.restatements(d, **k).collect()))

    want = sorted(map(tuple, G._by_rounds(cluster.held(docs, named), G.SAME, G.SAME_ENDS).collect()))
    assert len(want) > 20
    assert got(docs, named=named) == want
    assert [name for name, _ in stored] == ["restated"] and stored[0][1].count("Exchange hashpartitioning") == 1
    assert got(cluster.held(docs, named)) == want
    dealt = docs.repartition(4, "user_id")
    assert got(dealt, named=named) == want and "ENSURE_REQUIREMENTS" not in stored[0][1]
    monkeypatch.setattr(cluster, "BLOCK", 5)
    assert got(docs, named=named) == want and len(stored) > 2
    # one group fits a block, two don't
    monkeypatch.setattr(cluster, "BLOCK", 60)
    few = docs.filter((F.col("user_id") != "u1") | (F.col("id") < 200))
    assert got(few, named=named) == sorted(map(tuple, G._by_rounds(cluster.held(few, named), G.SAME, G.SAME_ENDS).collect()))


def test_near_pairs_name_their_vectors(spark, sf, tmp_path, monkeypatch):
    """No text and no vector is shuffled or stored, in groups of any size; a row without a text has no set of numbers."""
    from pyspark.sql import functions as F

    from recallgrid import catalog
    from recallgrid.operators import cluster

    for t in ("events", "labels", "embeddings"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.when(F.col("doc_id") % 5 == 3, None).when(F.col("doc_id") % 5 < 2, F.concat(F.lit("no "), F.col("doc_id") % 2)).otherwise(F.col("text"))
    # few owners, so that groups are larger than a cell's block
    docs.withColumns({"text": text, "source": F.concat(F.lit("s"), F.col("doc_id") % 2)}).write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    for t, path in (("documents", "documents.parquet/*.parquet"), *((t, f"{t}.parquet") for t in ("events", "labels", "embeddings"))):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{path}'")
    want = sorted(duck.sql(catalog.oracle_sql()["near_pairs_same_numbers"]).fetchall())
    assert len(want) > 50
    travel, meet, saved = [], cluster.meet, cluster.saved
    monkeypatch.setattr(cluster, "meet", lambda rows, *a, **k: (travel.append(rows.dtypes), meet(rows, *a, **k))[1])
    monkeypatch.setattr(cluster, "saved", lambda df, name: (travel.append(df.dtypes), saved(df, name))[1])
    # a whole group, cells of one block, cells of several
    for block, cell in ((2000, 8), (4, 8), (4, 1)):
        monkeypatch.setattr(cluster, "BLOCK", block), monkeypatch.setattr(cluster, "CELL", cell), monkeypatch.setattr(cluster, "PIVOTS", 3)
        got = sorted(map(tuple, catalog.queries()["near_pairs_same_numbers"](spark, str(tmp_path)).collect()))
        assert got == want
        shuffled = plan(catalog.queries()["near_pairs_same_numbers"](spark, str(tmp_path)))
        assert "embedding" not in "".join(x for x in shuffled.splitlines() if "Exchange hash" in x)
    assert {kind for columns in travel for _, kind in columns} <= {"bigint", "int", "double"}
    # new rows ask alone, blocks in both orders
    df = spark.createDataFrame([(i, "u", [float(i % 3), float(i % 7), 1.0]) for i in range(90)], "id long, user_id string, embedding array<double>")
    pairs = {tuple(r) for r in cluster.similar_pairs(df, 0.9).collect()}
    asked = [tuple(r) for r in cluster.similar_pairs(df, 0.9, new=F.col("id") % 4 == 0).collect()]
    assert len(pairs) > 300 and sorted(asked) == sorted(x for x in pairs if x[0] % 4 == 0 or x[1] % 4 == 0)
