"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by size (shingles, in powers of two).  For a partition
with at most ``m`` shingles a document is cut into windows of ``2m`` at steps
of ``m``, so that any run of up to ``m`` lies inside one window and containment
of the item becomes a fair Jaccard similarity there.  A window is a candidate
when one of its ``HASHES`` minima equals the item's; candidates are verified by
the exact share of the item's distinct shingles in the whole document.

What the minima miss is found exactly: of an item's n shingles the
n - ceil(``CONTAINED`` n) + 1 that the fewest documents hold are its prefix,
and a document that holds none of these cannot hold enough of the rest.  Every
document with a prefix shingle is a candidate too, so no pair is lost.

Words are runs of letters and digits, lower-cased; shingles have five words.
An item of fewer words is one shingle, looked for among the document's runs of
that many words.  Defined cases: null or wordless texts match nothing; repeated
rows count as rows of their own, repeated item ids as one item with all their
shingles; empty tables give no rows.

Documents are read once.  What goes to the workers is a bitmap of fixed size,
whatever the number of items; rows that pass it (keys and shingles of the
items, and the few that collide) are shuffled and joined by Spark.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import WordHashes, ddl, mixed, shingles, tuned, written

WIDTH, CONTAINED, HASHES, BITMAP, LEAST = 5, 0.8, 24, 1 << 24, 8
WORD = re.compile(r"\w+")
FOUND = "doc_id:long keys:longs grams:longs"


def words(text: str | None) -> list[bytes]:
    return " ".join(WORD.findall(text.lower())).encode("utf-8", "surrogatepass").split(b" ") if text and WORD.search(text) else []


def size_class(n: int) -> int:
    """The largest size of an item's partition: a power of two from LEAST on."""
    return max(LEAST, 1 << (n - 1).bit_length())


def minima(grams: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size, an array (HASHES, windows) of the minima over windows of twice that size."""
    n = len(grams)
    blocks = -(-n // LEAST)
    out: dict[int, list] = {s: [] for s in sizes}
    for k in range(HASHES):
        h = mixed(grams, 100 + k)
        low = np.minimum.reduceat(h, np.arange(0, n, LEAST)) if n else h
        step = LEAST
        for s in sizes:
            while step < s:  # blocks of the next power of two
                if len(low) % 2:
                    low = np.append(low, np.uint64(2**64 - 1))
                low = np.minimum(low[::2], low[1::2])
                step *= 2
            out[s].append(np.minimum(low[:-1], low[1:]) if len(low) > 1 else low)
    return {s: np.array(v) for s, v in out.items()} if blocks else {}


def band(values: np.ndarray, size: int) -> np.ndarray:
    """Keys of the minima of a size partition; values is (HASHES, ...)."""
    salt = mixed(np.arange(HASHES, dtype=np.uint64) + np.uint64(size * 1000), 7)
    return mixed(values ^ salt.reshape(-1, *[1] * (values.ndim - 1)))


def slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64)


def _items(batches):
    """(item_id, words, keys, grams) of each item."""
    hashes = WordHashes()
    for b in batches:
        ids, sizes, keys, grams = [], [], [], []
        for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words(t)
            if not w:
                continue
            g = np.unique(shingles(hashes.of(w), WIDTH))
            ids.append(k)
            sizes.append(min(len(w), WIDTH) if len(w) < WIDTH else size_class(len(w) - WIDTH + 1) * 10)
            low = np.array([mixed(g, 100 + j).min() for j in range(HASHES)])
            keys.append((band(low, sizes[-1] // 10) if len(w) >= WIDTH else g).view(np.int64))
            grams.append(g.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))], names=["item_id", "size", "keys", "grams"])


def contamination(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every pair at or over ``contained``."""
    spark = docs.sparkSession
    tuned(spark)
    known = written(items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_items, "item_id bigint, size int, keys array<bigint>, grams array<bigint>"), "items")
    item_keys = known.select("item_id", F.explode("keys").alias("key")).distinct()
    item_grams = known.select("item_id", F.explode("grams").alias("gram")).distinct()
    # the sizes that occur: powers of two and lengths under five, so a few dozen at most
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())
    long_sizes, short = [s // 10 for s in sizes if s >= 10], [s for s in sizes if s < 10]

    def bits(batches):
        on = np.zeros((2, BITMAP // 8), np.uint8)
        for b in batches:
            for kind in (0, 1):
                at = slot(b.column(kind).flatten().to_numpy().view(np.uint64))
                np.bitwise_or.at(on[kind], at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([on.tobytes()], pa.binary())], names=["one", "bits"])

    on = np.zeros((2, BITMAP // 8), np.uint8)
    # one bitmap from each partition of the items, at most a handful: the item table is repartitioned to bound them
    for r in known.select("keys", "grams").coalesce(8).mapInArrow(bits, "one bigint, bits binary").toLocalIterator():
        on |= np.frombuffer(r.bits, np.uint8).reshape(2, -1)
    sent = spark.sparkContext.broadcast(on)

    def hit(one: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = slot(h)
        return (one[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def find(batches):
        hashes, (of_keys, of_grams) = WordHashes(), sent.value
        for b in batches:
            ids, keys, grams = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = hashes.of(words(t))
                if not len(w):
                    continue
                g = shingles(w, WIDTH) if len(w) >= WIDTH else w[:0]
                some = g[hit(of_grams, g)]
                got = []
                # without one shared shingle no minimum can be shared with an item
                if len(some):
                    for s, low in minima(g, long_sizes).items():
                        x = band(low, s).ravel()
                        got.append(x[hit(of_keys, x)])
                small = [x[hit(of_keys, x)] for n in short if len(w) >= n for x in (shingles(w, n),)]
                got += small
                found = np.unique(np.concatenate(got)) if got else g[:0]
                if len(found) or len(some):
                    ids.append(k)
                    keys.append(found.view(np.int64))
                    grams.append(np.unique(np.concatenate([some, *small])).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))], names=["doc_id", "keys", "grams"])

    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = written(base.mapInArrow(find, ddl(FOUND)), "found")
    by_minima = found.select("doc_id", F.explode("keys").alias("key")).join(item_keys, "key").select("doc_id", "item_id")
    doc_grams = found.select("doc_id", F.explode("grams").alias("gram")).distinct()
    size = item_grams.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    holders = doc_grams.join(item_grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("holders"))
    # an item's shingles are one partition: the window holds one item at a time
    rarest = F.row_number().over(Window.partitionBy("item_id").orderBy("holders", "gram"))
    ranked = item_grams.join(holders, "gram", "left").na.fill(0, ["holders"]).withColumn("rank", rarest).join(size, "item_id")
    prefix = ranked.where(F.col("rank") <= F.col("item_shingles") - F.ceil(F.col("item_shingles") * contained - 1e-9) + 1).select("item_id", "gram")
    by_prefix = doc_grams.join(prefix, "gram").select("doc_id", "item_id")
    candidates = by_minima.unionByName(by_prefix).distinct()
    shared = doc_grams.join(item_grams, "gram").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    return shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(size, "item_id").select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment")).where(F.col("containment") >= contained)


def op3(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, "doc_id", "text", items, "item_id", "text")


ORACLE = """
WITH words AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+') FROM benchmark),
grams AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g
          FROM words WHERE len(w) >= 5),
sizes AS (SELECT id, count(*) AS n FROM grams WHERE kind = 1 GROUP BY id),
hits AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared
         FROM grams d JOIN grams b ON d.kind = 0 AND b.kind = 1 AND d.g = b.g GROUP BY d.id, b.id)
SELECT doc_id, item_id, shared, n AS item_shingles, shared / n AS containment
FROM hits JOIN sizes ON item_id = id WHERE shared / n >= 0.8
"""
