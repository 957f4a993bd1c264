"""Corpus pipeline: language ID, near-duplicate join, substring dedup, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet in the shared folder and read again as the next stage's docs.  All but
the last return the columns of ``documents``.

Every row is a document of its own.  Where ids repeat or are null, a stage
numbers its rows in the order of (id, text), null ids last, and works with
those numbers; else with the ids.  So rows of one id and different texts are
judged apart, and of equal rows the join keeps one.  Extra columns pass
through whatever their names.  Texts that are null or have no letter go in the
first stage.  An empty table passes every stage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, language, ngram_join, packing, passages
from palimpsest.llm._common import drop, forget, made, written

#: A document is rejected when the posterior of its language is lower than this.
LEAST_SCORE = 0.5
ROW = "__row"


def _private(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that clash with nothing, and the new name of each column."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def _numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """With a column ``ROW`` that names one row each: the id, or a number in the order of (id, text)."""
    again = docs.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
    if again.isEmpty():
        return docs.withColumn(ROW, F.col(key).cast("long"))
    order = [F.col(key).asc_nulls_last(), F.xxhash64(text)]
    return written(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose ``ROW`` is not in the column gone, without that column."""
    return docs.join(gone, docs[ROW] == F.col("gone"), "left_anti").drop(ROW)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language of the labels; learned from all labelled documents."""
    own, of = _private(docs)
    judged = language.predict(own, of["text"], language.train(own, of["text"], of["lang"]), own.columns)
    return judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*own.columns).toDF(*docs.columns)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near duplicates (five words, 0.8)."""
    own, of = _private(docs)
    own = _numbered(own, of["doc_id"], of["text"])
    classes = ngram_join.jaccard_classes(own, ROW, of["text"], width=5, num=80, den=100)
    gone = written(classes.where("doc_id != component_id").select(F.col("doc_id").alias("gone")), "near-copies")
    forget(classes)
    return _without(own, gone).toDF(*docs.columns)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the passages that an earlier document has too; a document of which nothing is left goes."""
    own, of = _private(docs)
    own = _numbered(own, of["doc_id"], of["text"])
    found = passages.repeated_passages(own, ROW, of["text"])
    # a document's spans don't overlap, so they are fewer than its words
    spans = written(found.groupBy(F.col("doc_id").alias("gone")).agg(F.array_sort(F.collect_list(F.struct("start", "n_words"))).alias("spans")), "spans")
    forget(found)
    hit = own.join(spans, own[ROW] == F.col("gone")).drop(ROW, "gone")
    text, size = own.columns.index(of["text"]), own.columns.index(of["n_chars"]) if "n_chars" in of else None
    names = [c for c in own.columns if c != ROW]

    def cut(batches):
        for b in batches:
            texts = [passages.without_spans(t, [(r["start"], r["n_words"]) for r in runs]) for t, runs in zip(b.column(text).to_pylist(), b.column(len(names)).to_pylist(), strict=True)]
            keep = pa.array([passages.WORD.search(t) is not None for t in texts], pa.bool_())
            columns = list(b.columns[: len(names)])
            columns[text] = pa.array(texts, columns[text].type)
            if size is not None:
                columns[size] = pa.array(map(len, texts), columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return _without(own, spans.select("gone")).unionByName(hit.mapInArrow(cut, own.select(*names).schema)).toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    own, of = _private(docs)
    own = _numbered(own, of["doc_id"], of["text"])
    found = decontaminate.contamination(own, ROW, of["text"], spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")
    return _without(own, written(found.select(F.col("doc_id").alias("gone")).distinct(), "contaminated")).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack(docs, "doc_id", "text")


STAGES = [
    ("language_id", identified),
    ("ngram_jaccard_join", deduplicated),
    ("substring_dedup", without_passages),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]
#: Tokenizing and fitted models have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, last = made(), docs
        docs = written(stage(spark, last, sf_dir), name)
        drop(spark, before, docs)
        forget(last)
    return STAGES[-1][1](spark, docs, sf_dir)
