"""SimHash document fingerprints and the permuted block tables that search them.

Terms are runs of five words (single words where a text has fewer than five),
weighted by the bit length of their count.  The 128 bits of a term's hash vote
with that weight; a fingerprint bit is set where the sum is positive.

Defined cases: a null text is the empty text, whose fingerprint is all zeros;
equal texts have equal fingerprints; documents follow one another by
descending id, null ids last, equal ids by text; repeated rows are rows of
their own; a lone document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, ddl, forget, mixed, shingles, table, tuned, words_of, written

WIDTH, BITS, RADIUS, BLOCKS = 5, 128, 3, 4
ROWS, MOST = 2000, 10_000
EDITED = "doc_id:long n_chars:long edited_sha256:string fingerprint:string edited_fingerprint:string near_edited:double near_next:double hi:long lo:long"
#: One lane of a 64-bit word for each bit of a byte, so that up to 255 votes add at once.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def simhash(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of hashed words: two 64-bit numbers."""
    if not len(words):
        return np.zeros(2, np.uint64)
    terms, counts = np.unique(shingles(words, width) if len(words) >= width else mixed(words, 1), return_counts=True)
    both = np.empty((len(terms), 2), np.uint64)
    both[:, 0], both[:, 1] = mixed(terms, 11), mixed(terms, 12)
    lanes = LANES[both.view(np.uint8)]
    weight = np.frexp(counts.astype(np.float64))[1]  # bit length
    votes = np.zeros(BITS, np.int64)
    for w in np.unique(weight):
        own = lanes[weight == w]
        for at in range(0, len(own), 255):
            votes += int(w) * own[at : at + 255].sum(0).view(np.uint8)
    return np.packbits(2 * votes > int(weight.sum()), bitorder="little").view(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1 - int(np.bitwise_count(a ^ b).sum()) / BITS


def as_text(f: np.ndarray) -> str:
    return f"{int(f[0]):016x}{int(f[1]):016x}"


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def edited_fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every row's fingerprint, that of its edited text, and their likeness to the next document's.

    One shuffle of the texts: rows go to ranges of ids, cut at ids that occur,
    and the row at the head of a range goes to the range above it too, where
    the last row needs it.  At most ``MOST`` cuts return to the driver.
    """
    spark = docs.sparkSession
    tuned(spark)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = base.count()
    ranges = max(1, min(MOST, n // ROWS))
    ids = base.where("doc_id is not null").select(F.col("doc_id"))
    cuts = np.unique(np.array(ids.approxQuantile("doc_id", [(i + 1) / ranges for i in range(ranges)], 0.2 / ranges), np.int64)) if n else np.zeros(0, np.int64)
    top = ids.agg(F.max("doc_id")).first()[0] if n else None
    if top is not None:
        cuts = np.unique(np.append(cuts, np.int64(top)))
    parts = "bucket:long border:int doc_id:long text:string"

    def deal(batches):
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0 if k is None else int(np.searchsorted(cuts, k))
                rows.append((at, 0, k, t))
                if k is not None and cuts[at] == k:
                    rows.append(((at + 1) % len(cuts), 1, k, t))
            yield table(parts, rows)

    dealt = base.mapInArrow(deal, ddl(parts)).repartition(max(1, len(cuts)), "bucket").sortWithinPartitions(F.col("bucket"), F.col("border"), F.col("doc_id").desc_nulls_last(), F.col("text"))

    def judge(batches):
        hashes = WordHashes()
        prints = lambda t: simhash(hashes.of(words_of(t)))
        out, bucket, first, last = [], None, None, None

        def row(k, t, f, following, g):
            new = edited(t, following)
            e = prints(new)
            h, l = f.view(np.int64)
            return (k, len(t), hashlib.sha256(new.encode()).hexdigest(), as_text(f), as_text(e), likeness(f, e), likeness(f, g), int(h), int(l))

        for batch in batches:
            c = batch.to_pydict()
            for at, border, k, t in zip(c["bucket"], c["border"], c["doc_id"], c["text"], strict=True):
                if at != bucket:
                    if last:
                        out.append(row(*last, *first))
                    bucket, first, last = at, None, None
                if border and not last:
                    continue  # a further copy of the border row
                f = last[2] if last and last[1] == t else prints(t)
                if last:
                    out.append(row(*last, t, f))
                first = first or (t, f)
                last = None if border else (k, t, f)
            yield table(EDITED, out)
            out = []
        if last:
            out.append(row(*last, *first))
        yield table(EDITED, out)

    return dealt.mapInArrow(judge, ddl(EDITED))


def near_fingerprints(prints: DataFrame, asked: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (ahi, alo, hi, lo, distance) of asked and stored fingerprints within the radius.

    Both inputs have distinct (hi, lo).  The 128 bits are cut into ``blocks``;
    two fingerprints that differ in at most ``radius`` bits agree on some
    ``blocks - radius`` of them, so there is a table for each such choice,
    keyed by the bits chosen.  Each pair is counted in the first table where
    it meets.
    """
    if not 0 <= radius < blocks:
        raise ValueError("more blocks than the radius are needed")
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    chosen = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in some) for some in combinations(range(blocks), blocks - radius)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [(signed(m >> 64), signed(m & ((1 << 64) - 1))) for m in chosen]

    def tables(df: DataFrame, hi: str, lo: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col(hi).bitwiseAND(F.lit(a)).alias("kh"), F.col(lo).bitwiseAND(F.lit(b)).alias("kl")) for i, (a, b) in enumerate(masks)])
        return df.select(hi, lo, F.explode(keys).alias("k")).select(hi, lo, "k.*")

    pairs = tables(asked.select(F.col("hi").alias("ahi"), F.col("lo").alias("alo")), "ahi", "alo").join(tables(prints.select("hi", "lo"), "hi", "lo"), ["t", "kh", "kl"])
    xh, xl = F.col("ahi").bitwiseXOR(F.col("hi")), F.col("alo").bitwiseXOR(F.col("lo"))
    first = F.lit(len(masks))
    for i, (a, b) in reversed(list(enumerate(masks))):
        first = F.when((xh.bitwiseAND(F.lit(a)) == 0) & (xl.bitwiseAND(F.lit(b)) == 0), F.lit(i)).otherwise(first)
    distance = F.bit_count(xh) + F.bit_count(xl)
    return pairs.where((distance <= radius) & (first == F.col("t"))).select("ahi", "alo", "hi", "lo", distance.alias("distance"))


def op1(spark, sf_dir: str) -> DataFrame:
    """Adds n_near: how many other rows have a fingerprint within the radius, for ids divisible by 20."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = written(edited_fingerprints(docs, "doc_id", "text"), "fingerprints")
    classes = made.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max(F.coalesce(F.pmod("doc_id", F.lit(20)) == 0, F.lit(False))).alias("asked"))
    kept = written(classes, "fingerprint-classes")
    near = near_fingerprints(kept, kept.where("asked")).join(kept.select("hi", "lo", "n"), ["hi", "lo"]).groupBy("ahi", "alo").agg((F.sum("n") - 1).alias("n_near"))
    near = written(near.select(F.col("ahi").alias("hi"), F.col("alo").alias("lo"), "n_near"), "near")
    forget(kept)
    return made.join(near, ["hi", "lo"], "left").select(*[x.split(":")[0] for x in EDITED.split()[:-2]], F.when(F.pmod("doc_id", F.lit(20)) == 0, F.col("n_near")).alias("n_near"))
