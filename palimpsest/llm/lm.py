"""Bigram language model by deleted interpolation, counted and scored in batches.

``p(w|v) = l2 c(v,w)/c(v) + l1 c(w)/N + l0 / (V+1)`` with weights for each
frequency bucket of the context ``v`` (powers of two), learned by
expectation-maximisation on counts of the held-out sixteenth of the training
documents against the counts of the others; scoring uses the counts of all
training documents.  A document begins in the context of the end mark.

Scale.  A batch is about ``TOKENS`` tokens packed as arrays and written to the
shared folder.  It sends its distinct n-grams with their counts to shards by
hash and gets the totals back: one exchange each way, proportional to the
distinct n-grams, nothing per token and nothing to the driver but the sizes
and one grid of fixed size for the weights.  Every n-gram of a batch is one
key however often it occurs.  More than ``FAN`` batches are combined in a tree
of groups of about so many, and totals come down the same way, so a shard
never gathers a frequent n-gram from all batches at once.

Defined cases: a null text is empty (the end mark alone); null ids train;
repeated rows count as often as they occur; without training rows N and V are
0 and only the uniform part is left; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import MIX, WordHashes, drop, made, mixed, packed_keys, planes, tuned, unpacked_keys, unplanes, words_of, written
from .language import held_out

TOKENS, SHARD_KEYS, DEV, FAN = 300_000, 1_000_000, 16, 4096
CONTEXTS, STEPS, ITERATIONS = 32, 64, 60
END = np.uint64(xxhash.xxh3_64_intdigest(b"\x00end"))
PACKED = "batch bigint, dev int, n_tokens bigint, ids array<bigint>, held array<boolean>, lengths binary, words binary, stream binary"
MESSAGE = "shard bigint, batch bigint, dev int, kind int, keys binary, counts binary, dev_counts binary"
REPLY = "batch bigint, shard bigint, dev int, kind int, total binary, dev_total binary, n_types bigint, n_tokens bigint, n_dev bigint"


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class Packer:
    """Documents of one kind gathered into a batch."""

    def __init__(self, dev: int):
        self.dev, self.n, self.docs = dev, 0, 0
        self.clear()

    def clear(self) -> None:
        self.ids, self.held, self.words, self.size = [], [], [], 0

    def add(self, key, held: bool, words: np.ndarray) -> None:
        self.ids.append(key)
        self.held.append(held)
        self.words.append(np.append(words, END))
        self.size += len(words) + 1

    def batch(self) -> pa.RecordBatch:
        vocab, stream = np.unique(np.concatenate(self.words), return_inverse=True)
        number = (TaskContext.get().partitionId() << 24) + 2 * self.n + self.dev
        self.n += 1
        out = batch_of(PACKED, [[number], [self.dev], [self.size], [self.ids], [self.held], [planes(np.array([len(w) for w in self.words], np.uint32))], [packed_keys(vocab)], [planes(stream.astype(np.uint32))]])
        self.clear()
        return out


class Batch:
    """A packed batch with its distinct n-grams, the same each time it is opened."""

    def __init__(self, row: dict):
        self.ids, self.held = row["ids"], np.array(row["held"], bool)
        self.lengths = unplanes(row["lengths"], np.uint32).astype(np.int64)
        self.vocab, self.stream = unpacked_keys(row["words"]), unplanes(row["stream"], np.uint32).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        end = int(np.searchsorted(self.vocab, END))
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        before[self.starts] = end
        self.before = before
        pairs, self.pair = np.unique(before * len(self.vocab) + self.stream, return_inverse=True)
        with np.errstate(over="ignore"):
            two = mixed(self.vocab[pairs // len(self.vocab)] * MIX + self.vocab[pairs % len(self.vocab)], 2)
        self.keys, self.order = [], []
        for h in (mixed(self.vocab, 1), two):
            order = np.argsort(h, kind="stable")
            self.keys.append(h[order])
            self.order.append(order)

    def counts(self) -> list[np.ndarray]:
        """Training counts in the order of the keys."""
        train = np.repeat(~self.held, self.lengths)
        return [np.bincount(at[train], minlength=len(o)).astype(np.uint64)[o] for at, o in zip((self.stream, self.pair), self.order, strict=True)]

    def totals(self, replies: list, column: str) -> tuple[np.ndarray, np.ndarray]:
        """Totals of words and of pairs in this batch's own numbering; replies sorted by (kind, shard)."""
        out = []
        for kind in (0, 1):
            got = np.concatenate([unplanes(r[column], np.uint64) for r in replies if r["kind"] == kind])
            one = np.empty(len(got), np.float64)
            one[self.order[kind]] = got
            out.append(one)
        return tuple(out)


def cells(x: np.ndarray) -> np.ndarray:
    """Half-bit steps of a probability; the last one holds zero."""
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.minimum(np.floor(-2 * np.log2(np.maximum(x, 1e-300))), STEPS - 2), STEPS - 1).astype(np.int64)


def context(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(c)[1], CONTEXTS - 1)


def weights(grid: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (l2, l1, l0) of each context bucket from held-out counts (CONTEXTS, STEPS, STEPS)."""
    p = 2.0 ** (-(np.arange(STEPS) + 0.5) / 2)
    p[-1] = 0
    parts = np.stack([np.broadcast_to(p[:, None], (STEPS, STEPS)), np.broadcast_to(p[None, :], (STEPS, STEPS)), np.full((STEPS, STEPS), uniform)])
    out = np.full((CONTEXTS, 3), 1 / 3)
    whole = np.full(3, 1 / 3)
    for _ in range(ITERATIONS):
        share = out[:, :, None, None] * parts
        got = (grid[:, None] * share / share.sum(1, keepdims=True)).sum((2, 3))
        whole = (got.sum(0) + 1e-9) / (got.sum() + 3e-9)
        out = (got + whole) / (got + whole).sum(1, keepdims=True)  # one more token as in all buckets together
    out[0, 1:] += out[0, 0] / 2  # an unseen context has no pairs
    out[0, 0] = 0
    return out


def _summed(group: pa.Table):
    """Of each kind in a group of MESSAGE: its rows, distinct keys, each row's places in them, and the sums of all and of dev counts."""
    for kind in (0, 1):
        rows = group.filter(pc.equal(group.column("kind"), kind)).to_pydict()
        if not rows["batch"]:
            continue
        keys = [unpacked_keys(k) for k in rows["keys"]]
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        every, dev = np.zeros(len(found), np.uint64), np.zeros(len(found), np.uint64)
        own = np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])
        for at, c, d, flag in zip(own, rows["counts"], rows["dev_counts"], rows["dev"], strict=True):
            if c is None:
                continue
            every[at] += (c := unplanes(c, np.uint64))
            if d or flag:
                dev[at] += unplanes(d, np.uint64) if d else c
        yield kind, rows, found, own, every, dev


def _told(rows: dict, own: list, every: np.ndarray, dev: np.ndarray, kind: int) -> list[tuple]:
    return [(b, s, d, kind, planes(every[at]), planes(dev[at]) if d else None, None, None, None) for b, s, d, at in zip(rows["batch"], rows["shard"], rows["dev"], own, strict=True)]


def _total_up(group: pa.Table) -> pa.Table:
    """REPLY to each message of a shard, and its sizes as one row of batch -1."""
    out = []
    for kind, rows, _, own, every, dev in _summed(group):
        if kind == 0:
            out.append((-1, rows["shard"][0], 0, 0, None, None, int((every > 0).sum()), int(every.sum()), int(dev.sum())))
        out += _told(rows, own, every, dev, kind)
    return pa.Table.from_batches([batch_of(REPLY, list(zip(*out, strict=True)))])


def totals(sent: DataFrame, batches: int, fan: int = FAN) -> DataFrame:
    """REPLY to every message: the sums over all batches of the n-grams it names."""
    if batches <= fan:
        return sent.groupBy("shard").applyInArrow(_total_up, REPLY)
    parts = -(-batches // fan)

    def fold(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        out = [(rows["shard"][0], part, 1, kind, packed_keys(found), planes(every), planes(dev)) for kind, rows, found, _, every, dev in _summed(group.drop_columns("part"))]
        return pa.Table.from_batches([batch_of(MESSAGE, list(zip(*out, strict=True)))])

    def hand_down(group: pa.Table) -> pa.Table:
        """Replies to the messages of a part, from the reply to the part itself, whose rows have no keys."""
        answers = {r["kind"]: r for r in group.filter(pc.is_null(group.column("keys"))).to_pylist()}
        out = []
        for kind, rows, _, own, _, _ in _summed(group.filter(pc.is_valid(group.column("keys"))).drop_columns("part")):
            out += _told(rows, own, unplanes(answers[kind]["counts"], np.uint64), unplanes(answers[kind]["dev_counts"], np.uint64), kind)
        return pa.Table.from_batches([batch_of(REPLY, list(zip(*out, strict=True)))])

    sent = written(sent.withColumn("part", F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("bigint")), "messages")
    folded = written(sent.groupBy("shard", "part").applyInArrow(fold, MESSAGE), "folded")
    above = written(totals(folded, parts, fan), "folded-replies")
    answers = above.where("batch >= 0").select("shard", F.col("batch"), "dev", "kind", F.lit(None).cast("binary").alias("keys"), F.col("total").alias("counts"), F.col("dev_total").alias("dev_counts"), F.col("batch").alias("part"))
    down = sent.withColumn("counts", F.lit(None).cast("binary")).unionByName(answers)
    return down.groupBy("shard", "part").applyInArrow(hand_down, REPLY).unionByName(above.where("batch = -1"))


def score_corpus(docs: DataFrame, key: str, text: str, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    tuned(spark)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), held.alias("held"), (~held & (F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(5)), F.lit(DEV)) == 0)).alias("dev"))

    def pack(batches):
        hashes, kinds = WordHashes(), (Packer(0), Packer(1))
        for b in batches:
            for k, t, h, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                to = kinds[int(d)]
                to.add(k, h, hashes.of(words_of(t)))
                if to.size >= TOKENS:
                    yield to.batch()
        for to in kinds:
            if to.size:
                yield to.batch()

    packed = written(base.mapInArrow(pack, PACKED), "packed")
    total = packed.agg(F.sum("n_tokens")).first()[0] or 0
    bits = max(3, (max(1, total) // SHARD_KEYS).bit_length())

    def send(batches):
        for b in batches:
            for row in b.to_pylist():
                one = Batch(row)
                for kind, (keys, counts) in enumerate(zip(one.keys, one.counts(), strict=True)):
                    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                    rows = [(s, row["batch"], row["dev"], kind, packed_keys(k), planes(c), None) for s, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)) if len(k)]
                    yield batch_of(MESSAGE, list(zip(*rows, strict=True)))

    before = made()
    replies = written(totals(packed.mapInArrow(send, MESSAGE), packed.count()), "replies")
    drop(spark, before, replies)
    sizes = replies.where("batch = -1").agg(F.sum("n_types"), F.sum("n_tokens"), F.sum("n_dev")).first()
    n_types, n_train, n_dev = (int(x or 0) for x in sizes)
    gathered = replies.where("batch >= 0").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("kind", "shard", "total", "dev_total"))).alias("replies"))
    uniform = 1 / (n_types + 1)
    grid_of = "cell bigint, n double"

    def count_dev(batches):
        grid = np.zeros(CONTEXTS * STEPS * STEPS)
        for b in batches:
            for row in b.to_pylist():
                one = Batch(row)
                (c1, c2), (d1, d2) = one.totals(row["replies"], "total"), one.totals(row["replies"], "dev_total")
                c1, c2 = c1 - d1, c2 - d2
                seen = c1[one.before]
                f2 = np.divide(c2[one.pair], seen, out=np.zeros(len(seen)), where=seen > 0)
                f1 = c1[one.stream] / max(1, n_train - n_dev)
                grid += np.bincount((context(seen) * STEPS + cells(f2)) * STEPS + cells(f1), minlength=len(grid))
        at = np.flatnonzero(grid)
        yield batch_of(grid_of, [at, grid[at]])

    grid = np.zeros(CONTEXTS * STEPS * STEPS)
    got = packed.where("dev = 1").join(gathered, "batch").mapInArrow(count_dev, grid_of).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    grid[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    mix = weights(grid.reshape(CONTEXTS, STEPS, STEPS), uniform)
    scored = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def score(batches):
        for b in batches:
            for row in b.to_pylist():
                one = Batch(row)
                c1, c2 = one.totals(row["replies"], "total")
                own, seen = c1[one.stream], c1[one.before]
                lam = mix[context(seen)]
                f2 = np.divide(c2[one.pair], seen, out=np.zeros(len(seen)), where=seen > 0)
                p = np.log10(lam[:, 0] * f2 + lam[:, 1] * own / max(1, n_train) + lam[:, 2] * uniform)
                plain = np.log10((own + 0.5) / (n_train + 0.5 * (n_types + 1)))
                total = lambda x: np.add.reduceat(x, one.starts)
                yield batch_of(scored, [one.ids, one.held, one.lengths, total((own > 0).astype(np.int64)), [n_train] * len(one.ids), total(plain), total(p)])

    return packed.join(gathered, "batch").mapInArrow(score, scored)


def op5(spark, sf_dir: str) -> DataFrame:
    return score_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", held_out("doc_id", 5, 1))
