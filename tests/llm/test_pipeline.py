"""Each stage does what its operator says, on all rows that the one before kept."""

import corpus_pipeline as P
from recallgrid.llm import common, decontaminate, ngram_join, quality, secrets
from recallgrid.llm.common import documents


def test_stages(spark, sf):
    docs = documents(spark, sf)
    cols = docs.columns
    first = P.quality_stage(spark, docs, sf).cache()
    assert first.columns == cols
    assert {r["doc_id"] for r in first.collect()} == {r["doc_id"] for r in quality.quality_rules(docs).collect() if r["kept"]}
    second = P.near_duplicate_stage(spark, first, sf).cache()
    assert second.columns == cols
    assert {r["doc_id"] for r in second.collect()} == {r["component_id"] for r in ngram_join.ngram_join(first).collect()}
    third = P.decontamination_stage(spark, second, sf).cache()
    bad = {r["doc_id"] for r in decontaminate.matches(second, spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r["contaminated"]}
    assert third.columns == cols and {r["doc_id"] for r in third.collect()} == {r["doc_id"] for r in second.collect()} - bad
    fourth = P.secrets_stage(spark, third, sf).cache()
    assert fourth.columns == cols
    before = {r["doc_id"]: r["text"] for r in third.collect()}
    assert all(r["text"] == secrets.mask(before[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in fourth.collect())
    last = P.mixing_stage(spark, fourth, sf).collect()
    assert last and all(0 < r["taken"] <= 2 * r["size"] for r in last)


def test_awkward_rows(spark, sf):
    """Rows without a doc_id or with a shared one, empty texts, and names that clash, through every stage."""
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(60)) + "."
    a, b, c = text(), text(), text()
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(None, a), (5, b), (5, c), (7, b), (None, a), (8, None), (9, ""), (10, item)]
    d = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4, "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _doc_id long, row long, doc long, g string")
    first = P.quality_stage(spark, d, sf)
    assert first.columns == d.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in first.collect()) == sorted((str(i), t) for i, t in rows if t)
    second = P.near_duplicate_stage(spark, d, sf)
    assert second.columns == d.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in second.collect()) == sorted((str(i), str(t)) for i, t in [(None, a), (5, b), (5, c), (8, None), (9, ""), (10, item)])
    third = P.decontamination_stage(spark, d, sf)
    assert third.columns == d.columns and sorted(str(r["doc_id"]) for r in third.collect()) == sorted(str(i) for i, _ in rows if i != 10)
    assert P.secrets_stage(spark, d, sf).columns == d.columns and P.secrets_stage(spark, d, sf).count() == len(rows)
    assert {r["doc_id"] for r in P.mixing_stage(spark, d, sf).collect()} <= {None, 5, 7, 10}
    none = d.limit(0)
    assert [f(spark, none, sf).count() for _, f in P.STAGES] == [0] * 5


def test_spent_tables_go(spark, tmp_path, monkeypatch):
    """run() leaves its result and nothing else in the shared folder."""
    import duckdb

    for t in ("documents", "benchmark"):
        duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet' LIMIT 60) TO '{tmp_path}/{t}.parquet' (FORMAT PARQUET)")
    root = tmp_path / "shared"
    monkeypatch.setattr(common, "stage_root", lambda spark: f"file://{root}")
    assert P.run(spark, str(tmp_path)).count() > 0
    assert [p.name.split("-")[0] for p in root.iterdir()] == ["mixing"]
