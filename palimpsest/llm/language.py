"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased letter by letter, everything else becomes a space, and
n-grams of ``ORDERS`` characters are hashed into ``BUCKETS`` counters for each
language.  All labelled training rows count; tasks fold their counts before
the shuffle.  The log-probability matrix (languages x buckets) is broadcast:
its size depends on the number of languages alone.  Scoring looks up a whole
batch at once in numpy.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
with no labelled training row everything is ``und``; ties go to the language
first in alphabetical order; null labels don't train; texts longer than
``PIECE`` characters are worked through in parts, which lose no n-gram.  The score is the
posterior of the best language with the evidence tempered to at most
``EVIDENCE`` independent n-grams, so that it stays informative on long texts.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ddl, mixed, table, tuned

BUCKETS, ORDERS, EVIDENCE = 1 << 15, (1, 2, 3), 64
PIECE = 1 << 17
UNKNOWN = "und"
SPACE = np.uint32(32)


@cache
def _letters() -> np.ndarray:
    """Lower-case form of each code point that is a letter, else a space."""
    out = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(texts: list[str], starts_in: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, which text each belongs to, and whether a text has a letter.

    ``starts_in``: of each text, only n-grams that start in so many first characters.
    """
    data = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    data = _letters()[data]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(texts) else np.zeros(0, np.int64)
    has = np.add.reduceat(data != SPACE, starts) > 0 if len(texts) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    found, owners, code = [], [], np.zeros(len(data), np.uint64)
    letter = data != SPACE
    inside = None if starts_in is None else np.arange(len(data)) - starts[owner] < np.array(starts_in, np.int64)[owner]
    for k in range(max(ORDERS)):
        # a gram that starts at i takes characters i..i+k of the same text; one of spaces alone is left out
        n = len(data) - k
        if n <= 0:
            break
        code = (code[:n] << np.uint64(21)) | data[k:]
        some = letter[:n] | letter[k:]
        if k + 1 in ORDERS:
            some_here = some & (owner[:n] == owner[k:])
            keep = np.flatnonzero(some_here if inside is None else some_here & inside[:n])
            found.append((mixed(code[keep], k + 1) >> np.uint64(64 - 15)).astype(np.int32))
            owners.append(owner[keep])
    return np.concatenate(found) if found else np.zeros(0, np.int32), np.concatenate(owners) if owners else np.zeros(0, np.int32), has


def pieces(texts: list[str | None]):
    """Runs of (index, text, n) of about PIECE characters.

    A longer text is cut; the n-grams that start in the first n characters of
    a part are its own, the few characters after them complete the last ones.
    """
    run, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t), PIECE) if t else ():
            run.append((i, t[at : at + PIECE + max(ORDERS) - 1], min(PIECE, len(t) - at)))
            size += len(run[-1][1])
            if size >= PIECE:
                yield run
                run, size = [], 0
    if run:
        yield run


def train(docs: DataFrame, text: str, label: str) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix, the last column being the prior's."""
    tuned(docs.sparkSession)
    schema = "label:string bucket:int n:long"

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            texts, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            for run in pieces(texts):
                buckets, owners, _ = grams([t for _, t, _ in run], [n for _, _, n in run])
                names = sorted({labels[i] for i, _, _ in run})
                which = np.array([names.index(labels[i]) for i, _, _ in run], np.int32)[owners]
                for k, name in enumerate(names):
                    one = seen.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    one[:BUCKETS] += np.bincount(buckets[which == k], minlength=BUCKETS)
            for name in labels:
                seen.setdefault(name, np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += 1
        for name, one in seen.items():
            at = np.flatnonzero(one)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(one[at], pa.int64())], names=["label", "bucket", "n"])

    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("label is not null").mapInArrow(count, ddl(schema)).groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    labels = np.array(got.column("label").to_pylist(), dtype=object)
    names = sorted(set(labels))
    counts = np.zeros((len(names), BUCKETS + 1))
    if names:
        index = {x: i for i, x in enumerate(names)}
        counts[[index[x] for x in labels], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    body, docs_of = counts[:, :BUCKETS] + 0.5, counts[:, BUCKETS:]
    out = np.hstack([np.log(body) - np.log(body.sum(1, keepdims=True)), np.log(docs_of + 1) - np.log(docs_of.sum() + len(names) + (not names))])
    return names, out.astype(np.float32)


def predict(docs: DataFrame, text: str, model: tuple[list[str], np.ndarray], keep: list[str | Column] = ()) -> DataFrame:
    """``keep`` columns of every row, then lang_pred and score."""
    spark = docs.sparkSession
    names, matrix = model
    sent = spark.sparkContext.broadcast((np.ascontiguousarray(matrix[:, :BUCKETS].T), matrix[:, BUCKETS]))
    base = docs.select(*keep, F.col(text).alias("__text")) if text not in keep else docs.select(*keep)
    width = len(keep)
    place = keep.index(text) if text in keep else width

    def score(batches):
        table_of, prior = sent.value
        for b in batches:
            texts = b.column(place).to_pylist()
            logs, n, has = np.zeros((len(texts), len(names))), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
            for run in pieces(texts):
                at = np.array([i for i, _, _ in run])
                buckets, owners, letters = grams([t for _, t, _ in run], [m for _, _, m in run])
                np.logical_or.at(has, at, letters)
                for k in range(len(names)):
                    np.add.at(logs[:, k], at, np.bincount(owners, table_of[:, k][buckets], len(run)))
                np.add.at(n, at, np.bincount(owners, minlength=len(run)))
            lang, points = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if names and len(texts):
                x = logs * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None] + prior
                best = x.argmax(1)
                points = np.where(has, 1 / np.exp(x - x.max(1, keepdims=True)).sum(1), 0.0)
                lang = [names[j] if h else UNKNOWN for j, h in zip(best, has, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(lang, pa.string()), pa.array(points, pa.float64())], names=[*b.schema.names[:width], "lang_pred", "score"])

    kept = base.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return base.mapInArrow(score, kept)


def held_out(key: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", held_out("doc_id", 4, 2).alias("held_out"))
    return predict(docs, "text", train(docs.where("not held_out"), "text", "lang"), ["doc_id", "held_out"])
