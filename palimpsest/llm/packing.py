"""Best-fit packing of tokenised documents by bin completion.

Only lengths matter to a packing, so the search runs over the histogram of
piece lengths (at most ``capacity`` entries, however many documents).  Around
the largest remaining length it enumerates undominated completions, applies
each as often as the histogram allows, prunes by the waste that the incumbent
leaves and starts from the best-fit-decreasing packing as incumbent.  The plan,
a list of runs (length, first rank, count, first sequence, offset), is applied
to the pieces by their rank among equal lengths.

Defined cases: a null text is empty and has the end mark alone; repeated rows
are documents of their own; an empty table gives no rows.  Only documents over
``capacity`` tokens are cut.  ``NODES`` bounds the search; where it ends early
the incumbent is returned, which holds every piece all the same.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import ddl, tuned, written

CAPACITY, END_ID, NODES, WIDTH, WORDS = 4096, 1, 2000, 6, 150_000
VOCAB = "word_bpe_49k.json"
#: Rows of one (length, salt) group; a length that a third of all rows have is spread over the salts.
GROUP_ROWS = 200_000
PIECES = "doc_id:long piece:int start:long length:long ids_crc32:long"
#: White space to Python but not to the tokenizer's pattern, and marks that span words.
UNSAFE = re.compile("[\x1c-\x1f]|<\\|")


def vocabulary_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Ids of a text as little-endian bytes; words between white space are encoded once and remembered, up to ``WORDS``.

    The merges of the vocabulary file are loaded as ranks over bytes, a word's
    end being the byte 0xFF, which UTF-8 never has: merging it to the last byte
    first gives the vocabulary's word-end symbols.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in own]
        chars = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}
        symbol = {b: c for c, b in chars.items()}

        def raw(token: str) -> bytes:
            word = token.removesuffix(suffix)
            return bytes(chars[c] for c in word) + b"\xff" * (word != token)

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        ids = [vocab[symbol[b]] for b in range(256)] + [vocab[symbol[b] + suffix] for b in range(255)]
        for a, b in spec["model"]["merges"]:
            ranks[raw(a) + raw(b)] = len(ids)
            ids.append(vocab[a + b])
        self.merge = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split, self.ids = regex.compile(split), [i.to_bytes(4, "little") for i in ids]

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if word.isascii():
            low = word.lower()
            parts = (low,) if low.isalpha() else self.split.findall(low)
        else:
            word = unicodedata.normalize("NFC", word)
            low = "".join(c.lower() for c in word) if "\u03a3" in word else word.lower()  # no final sigma
            parts = self.split.findall(low)
        ids, merge = self.ids, self.merge
        return b"".join([ids[i] for p in parts for i in merge(p.encode() + b"\xff")])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        self[word] = out = self.word(word)
        return out

    def __call__(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


@functools.cache
def encoder(path: str) -> Encoder:
    """One a worker: tasks that follow in it find the merges loaded and the words remembered."""
    return Encoder(path)


def pieces(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row for each piece of each document, with its length and the checksum of its ids."""
    tuned(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        encode = encoder(vocabulary or vocabulary_path())  # where this worker has it
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                texts = [t or "" for t in b.column(1).to_pylist()]
                rows = []
                for k, t in zip(b.column(0).to_pylist(), texts, strict=True):
                    ids = encode(t) + end
                    for p, x in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[x : x + 4 * capacity]
                        rows.append((k, p, x // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[x.split(":")[0] for x in PIECES.split()])

    return base.mapInArrow(run, ddl(PIECES))


class Stock:
    """Counts of lengths, with the largest present length at most x found in logarithmic time."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.counts)

    def copy(self) -> Stock:
        out = Stock.__new__(Stock)
        out.counts, out.sizes = dict(self.counts), list(self.sizes)
        return out

    def fit(self, room: int) -> int:
        """Index of the largest length of at most room; -1 if none."""
        return bisect_right(self.sizes, room) - 1

    def take(self, filling: tuple[int, ...]) -> int:
        """Use a filling as often as the counts allow; how often that was."""
        need = Counter(filling)
        times = min(self.counts[k] // n for k, n in need.items())
        for k, n in need.items():
            self.counts[k] -= times * n
            if not self.counts[k]:
                del self.counts[k]
                self.sizes.pop(bisect_right(self.sizes, k) - 1)
        return times

    def put(self, filling: tuple[int, ...], times: int) -> None:
        """Undo such a use."""
        for k, n in Counter(filling).items():
            if k not in self.counts:
                insort(self.sizes, k)
                self.counts[k] = 0
            self.counts[k] += times * n


def best_fit(stock: Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over the histogram: the largest length, then always the largest that still fits."""
    stock, plan = stock.copy(), []
    while stock.sizes:
        need: Counter[int] = Counter()
        filling, room = [], capacity
        at = len(stock.sizes) - 1
        while at >= 0:
            x = stock.sizes[at]
            if x <= room and need[x] < stock.counts[x]:
                filling.append(x)
                need[x] += 1
                room -= x
                at = min(at, stock.fit(room))
            else:
                at = min(at - 1, stock.fit(room))
        plan.append((tuple(filling), stock.take(tuple(filling))))
    return plan


def completions(stock: Stock, capacity: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Fillings around the largest length, least waste first, dominated ones left out.

    A filling is dominated when one of its lengths could be exchanged for a
    larger one that is still there and still fits.  Depth-first from large to
    small, ended by the first ``width`` that fill the bin exactly.
    """
    largest = stock.sizes[-1]
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [400]

    def grow(filling: list[int], room: int, top: int) -> None:
        budget[0] -= 1
        if budget[0] < 0 or sum(1 for w, _ in found if not w) >= width:
            return
        at = min(top, stock.fit(room))
        if at < 0:
            found.append((room, tuple(filling)))
            return
        # few branches at each depth: the largest that fits, an exact end, then the next smaller ones
        exact = stock.fit(room)
        if exact <= top and stock.sizes[exact] == room and stock.counts[room] > filling.count(room):
            found.append((0, (*filling, room)))
        tried = 0
        while at >= 0 and tried < 4:
            x = stock.sizes[at]
            if stock.counts[x] > filling.count(x):
                tried += 1
                grow([*filling, x], room - x, at)
            at -= 1
        if not tried:
            found.append((room, tuple(filling)))

    grow([largest], capacity - largest, len(stock.sizes) - 1)
    out: list[tuple[int, tuple[int, ...]]] = []
    for waste, f in sorted(set(found), key=lambda x: (x[0], [-v for v in x[1]])):
        need = Counter(f)
        dominated = any((j := stock.fit(x + waste)) >= 0 and stock.sizes[j] > x and need[stock.sizes[j]] < stock.counts[stock.sizes[j]] for x in f[1:])
        if not dominated:
            out.append((waste, f))
        if len(out) == width:
            break
    return [f for _, f in out] or [min(found)[1]]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings with how often each is used; every length is used exactly as often as it occurs.

    Not all undominated fillings are tried: ``completions`` ends after 400
    calls, tries 4 lengths at each depth and keeps ``WIDTH`` fillings, of which
    2 are followed while 12 or more distinct lengths are left.  So the optimum
    can be missed before ``nodes`` run out.
    """
    stock = Stock(counts)
    total = sum(k * v for k, v in counts.items())
    bound = -(-total // capacity)
    best = best_fit(stock, capacity)
    size = sum(n for _, n in best)
    left = nodes
    # one stock follows the search: memory holds a path, not a histogram a node
    now, path = stock.copy(), []
    open_: list[tuple[int, tuple[int, ...], int, int]] = [(0, (), 0, 0)]
    while open_ and size > bound and left > 0:
        depth, filling, used, wasted = open_.pop()
        left -= 1
        while len(path) > depth:
            now.put(*path.pop())
        if filling:
            n = now.take(filling)
            path.append((filling, n))
            used, wasted = used + n, wasted + n * (capacity - sum(filling))
        if wasted > (size - 1) * capacity - total:
            continue
        if not now.sizes:
            if used < size:
                best, size = list(path), used
            continue
        open_ += [(len(path), f, used, wasted) for f in reversed(completions(now, capacity)[: WIDTH if len(now.sizes) < 12 else 2])]
    return best


def runs(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset) in order of rank."""
    at: Counter[int] = Counter()
    out: dict[int, list] = {}
    first = 0
    for filling, times in plan:
        offset = 0
        for x in filling:
            out.setdefault(x, []).append((at[x], first, offset))
            at[x] += times
            offset += x
        first += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, key: str, text: str, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    spark = docs.sparkSession
    cut = written(pieces(docs, key, text, capacity, vocabulary), "pieces")
    salts = max(1, cut.count() // GROUP_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    lengths = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(runs(plan_packing(lengths, capacity)))
    before = groups.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def place(batches):
        of = plan.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts) if len(order) else ():
                rows = of[int(length[at[0]])]
                k = np.searchsorted(rows[:, 0], rank[at], side="right") - 1
                sequence[at] = rows[k, 1] + rank[at] - rows[k, 0]
                offset[at] = rows[k, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return placed.mapInArrow(place, ddl(PIECES) + ", sequence_id bigint, offset bigint")


def op7(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
