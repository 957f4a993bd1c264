"""The pipeline's stages on a small corpus, each against what it must keep."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontaminate, ngram_join, passages

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    extra = spark.createDataFrame([(5000, None, "en", "s", 0), (5001, "12 -- 34", "en", "s", 8), (5002, "an orphan text of some words in the house", "en", "s", 3)], docs.schema)
    docs = docs.unionByName(extra)
    said = corpus_pipeline.identified(spark, docs, SF).persist()
    assert said.columns == columns and said.count() == docs.count() - 2
    kept = corpus_pipeline.deduplicated(spark, said, SF).persist()
    classes = ngram_join.jaccard_classes(said, "doc_id", "text", 5, 80, 100)
    assert kept.columns == columns and kept.where("doc_id is not null").count() == classes.where("doc_id is not null").select("component_id").distinct().count()
    assert ngram_join.jaccard_classes(kept, "doc_id", "text", 5, 80, 100).where("doc_id != component_id").isEmpty()
    cut = corpus_pipeline.without_passages(spark, kept, SF).persist()
    assert cut.columns == columns and cut.dtypes == kept.dtypes
    changed = cut.alias("a").join(kept.alias("b"), "doc_id").where("a.text != b.text")
    found = passages.repeated_passages(kept, "doc_id", "text")
    assert changed.count() == found.select("doc_id").distinct().join(cut, "doc_id").count()
    assert cut.where(F.col("n_chars") != F.length("text")).where("doc_id < 5000").join(changed.select("doc_id"), "doc_id").isEmpty()
    clean = corpus_pipeline.decontaminated(spark, cut, SF).persist()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = decontaminate.contamination(cut, "doc_id", "text", bench, "item_id", "text").select("doc_id").distinct()
    assert clean.count() == cut.count() - bad.count() and clean.join(bad, "doc_id").isEmpty()
    packed = corpus_pipeline.packed(spark, clean, SF)
    assert packed.where("piece = 0").count() == clean.count()


def _documents(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def _text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(n))


def test_rows_of_one_id_are_judged_apart(spark):
    a, b, c, line = (_text(i, 120) for i in range(4))
    docs = _documents(spark, [(1, a), (1, b), (2, a), (2, a), (None, b), (None, c), (3, "")])
    kept = corpus_pipeline.deduplicated(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", a), ("1", b), ("None", c), ("3", "")])
    docs = _documents(spark, [(1, f"{a} {line}"), (1, b), (4, f"{line} {c}"), (4, b[:300]), (None, f"x {line} y")])
    cut = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.without_passages(spark, docs, SF).collect()}
    assert cut == {(1, f"{a} {line}", len(a) + 1 + len(line)), (1, b, len(b)), (4, c, len(c)), (4, b[:300], 300), (None, "x y", 3)}
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = _documents(spark, [(1, f"{a} {item}"), (1, b), (None, item), (None, c)])
    assert {(r.doc_id, r.text) for r in corpus_pipeline.decontaminated(spark, docs, SF).collect()} == {(1, b), (None, c)}


def test_clashing_names_and_long_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = " ".join([_text(5, 4000)] * 20)
    docs = docs.unionByName(_documents(spark, [(7000, long), (7001, long + " end")]))
    extra = ["score", "lang_pred", "gone", "cut", "spans", "node", "component", "sid", "__row", "__0", "a", "list"]
    for _, stage in corpus_pipeline.STAGES:
        plain = stage(spark, docs, SF)
        more = stage(spark, docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)]), SF)
        assert more.drop(*[c for c in extra if c not in plain.columns]).exceptAll(plain).isEmpty() and more.count() == plain.count()
    assert [r.doc_id for r in corpus_pipeline.deduplicated(spark, docs, SF).where("doc_id >= 7000").collect()] == [7000]


def test_repeated_passages_by_brute_force(spark):
    """The cut stage against all pairs of windows: every word that an earlier document has in a run of 50 goes."""
    lines = [_text(100 + i, 55) for i in range(3)]
    rows = [(i, f"{_text(i, 40)} {lines[i % 3]} {_text(50 + i, 40)}") for i in range(12)] + [(20, _text(90, 200))]
    seen, want = set(), {}
    for k, t in rows:
        w = t.split()
        runs = {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
        gone = {j for i in range(len(w) - 49) if tuple(w[i : i + 50]) in seen for j in range(i, i + 50)}
        want[k] = " ".join(x for j, x in enumerate(w) if j not in gone)
        seen |= runs
    got = {r.doc_id: r.text for r in corpus_pipeline.without_passages(spark, _documents(spark, rows), SF).collect()}
    assert got == want


def test_repeated_ids_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    twice = docs.unionByName(docs)
    assert corpus_pipeline.deduplicated(spark, twice, SF).count() == corpus_pipeline.deduplicated(spark, docs, SF).count()
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
