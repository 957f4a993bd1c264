"""Size-aware heavy-light Jaccard self-join over word n-gram sets.

Two documents link when ``den * |A n B| >= num * |A u B|``.  Equal sets are
folded into one first.  Light sets (up to a size chosen by cost) enumerate
their subsets of every size that a partner of theirs must share; the others
enter inverted lists under their rarest ``n - ceil(num n / den) + 1`` shingles
and the lists are scanned.  Any two linked sets meet in a subset or in a list.
The boundary weighs the subsets of each size against the lists' lengths as
measured over a hash sample of the lists; it decides cost alone.

A shingle's rarity is the sum of its words' log counts in a sketch of fixed
size over all documents; it only orders the shingles, any order gives the same
links.  Entries are dealt to ranges of (key, set), so a frequent key spreads
over many tasks.  A lower bound of the difference leaves few pairs for the
exact check: sketches whose bits flip with each shingle, of at least as many
bits as the set, differ in no more bits than the sets differ in shingles, and
the larger of two folds onto the smaller.

First, lists of up to ``SHORT`` sets give all pairs that the sketches allow,
and the pairs of a spanning forest of least differences are checked.  A set in
longer lists takes part in two of them, in one block of about ``BLOCK`` sets
of each.  Then, with the components these links make, what is left is
checked exactly: pairs of short lists across components, and in each longer
list the sets outside its largest component, block by block, against all
others of it.  So near copies cost what they have in members, not in links.

Defined cases: documents without text or words have no set, 0 shingles and
link with nothing; fewer words than the width make one shingle; repeated rows
link like any equal sets; a null id is never the component's id unless there
is no other; an empty table gives no rows.  The check compares 64-bit hashes
of shingles: a chance collision can add one to an overlap, never take one.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Forest, WordHashes, connected, forget, mixed, packed_keys, runs_of, shingles, tidy, tuned, unpacked_keys, words_of, written
from .lm import batch_of

SLOT_BITS, LEAST_BITS, SHORT, BLOCK, PIECE = 17, 256, 32, 256, 1024
#: Subsets of one set at most: beyond that no list is so long that enumerating would pay.
SUBSETS = 20_000
#: One list in so many is measured for the boundary.
MEASURED = 16
#: Rows up to which a table of set names is broadcast (about 50 bytes each).
SENT = 500_000
SETS = "doc_id bigint, n bigint, set binary, entries array<bigint>, flips binary, grams binary"
LISTS = "key bigint, ids array<bigint>, whole boolean"
PAIRS = "a bigint, b bigint, tree boolean"


def needed(n, m, num: int, den: int):
    """Least overlap of linked sets of n and m shingles."""
    return -(-num * (n + m) // (num + den))


def subset_sizes(n: int, light: int, num: int, den: int) -> list[int]:
    """Sizes of subsets that a light set of n must share with some light partner."""
    partners = range(max(1, -(-num * n // den)), min(light, den * n // num) + 1)
    return sorted({c for m in partners if (c := needed(n, m, num, den)) <= min(n, m)})


def prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def most_light(num: int, den: int) -> int:
    """The largest size of which all sets up to it have at most ``SUBSETS`` subsets."""
    n = 0
    while sum(comb(n + 1, c) for c in subset_sizes(n + 1, den * (n + 1) // num, num, den)) <= SUBSETS:
        n += 1
    return n


def choose_light(sizes: np.ndarray, scans: np.ndarray, num: int, den: int) -> int:
    """The boundary of least cost: sizes[n] sets of n shingles, whose list entries meet scans[n] others in all."""
    best, chosen, cost = np.inf, 0, 0.0
    heavy = np.array([prefix(n, num, den) if n else 0 for n in range(len(sizes))]) * sizes + scans
    for b in range(len(sizes)):
        if b:
            cost += sizes[b] * sum(comb(b, c) for c in subset_sizes(b, b, num, den))
        if cost + heavy[b + 1 :].sum() < best:
            best, chosen = cost + heavy[b + 1 :].sum(), b
    return chosen


def subset_keys(grams: np.ndarray, light: int, num: int, den: int) -> np.ndarray:
    n, out = len(grams), []
    with np.errstate(over="ignore"):
        spread = mixed(grams, 21)
        whole = spread.sum(dtype=np.uint64)
        for c in subset_sizes(n, light, num, den):
            left = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
            out.append(mixed(whole - spread[left].sum(1, dtype=np.uint64), 1000 + c))
    return np.concatenate(out) if out else grams[:0]


def slots(words: np.ndarray) -> np.ndarray:
    return (mixed(words, 31) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class Sets:
    """Turns texts into shingle sets with their list keys and sketches."""

    def __init__(self, width: int, num: int, den: int, rarity: np.ndarray):
        self.width, self.num, self.den, self.rarity, self.hashes = width, num, den, rarity, WordHashes()

    def row(self, text: str | None) -> tuple:
        w = self.hashes.of(words_of(text))
        grams, at = np.unique(shingles(w, self.width), return_index=True)
        n = len(grams)
        if not n:
            return 0, None, None, None, None
        rare = self.rarity[slots(w)].astype(np.uint64)
        width = min(self.width, len(w))
        score = sum(rare[k : len(rare) - width + 1 + k] for k in range(width))[at]
        order = (score << np.uint64(50)) | (grams >> np.uint64(14))
        p = prefix(n, self.num, self.den)
        keys = mixed(np.partition(order, p - 1)[:p], 41)
        return n, xxhash.xxh3_128_digest(grams.tobytes()), keys.view(np.int64), flips(grams), packed_keys(grams)


def flips(grams: np.ndarray) -> bytes:
    """The sketch of a set: each shingle flips one bit."""
    bits = max(LEAST_BITS, 1 << (len(grams) - 1).bit_length())
    on = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(on.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """The sketches of a group of sets, each also folded to half its size."""

    def __init__(self, raw: list[bytes]):
        self.size = np.array([len(x) for x in raw], np.int64)
        self.rows, self.place = {}, {}
        for c in np.unique(self.size).tolist():
            own, twice = np.flatnonzero(self.size == c), np.flatnonzero(self.size == 2 * c)
            full = [np.frombuffer(raw[i], np.uint64) for i in own]
            for i in twice:
                x = np.frombuffer(raw[i], np.uint64)
                full.append(x[: len(x) // 2] ^ x[len(x) // 2 :])
            place = np.full(len(raw), -1, np.int64)
            place[np.concatenate((own, twice))] = np.arange(len(full))
            self.rows[c], self.place[c] = np.array(full), place

    def difference(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bits that differ, for pairs of sets; 0 where sizes are too far apart to fold."""
        out = np.zeros(len(x), np.int64)
        common = np.minimum(self.size[x], self.size[y])
        for c in np.unique(common).tolist():
            at = np.flatnonzero((common == c) & (np.maximum(self.size[x], self.size[y]) <= 2 * c))
            rows, place = self.rows[c], self.place[c]
            step = max(1, (8 << 20) // c)
            for k in range(0, len(at), step):
                some = at[k : k + step]
                out[some] = np.bitwise_count(rows[place[x[some]]] ^ rows[place[y[some]]]).sum(1, dtype=np.int64)
        return out


def within(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of all pairs inside runs of equal values."""
    i, j, k = [], [], 1
    while len(at := np.flatnonzero(runs[k:] == runs[:-k])):
        i.append(at)
        j.append(at + k)
        k += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *i]), np.concatenate([none, *j])


def likely(n: np.ndarray, sketches: Sketches, x: np.ndarray, y: np.ndarray, num: int, den: int) -> tuple:
    """Those of the pairs (x, y) that sizes and sketches allow to link, and the bits that differ."""
    ok = den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])
    x, y = x[ok], y[ok]
    d = sketches.difference(x, y)
    ok = (num + den) * d <= (den - num) * (n[x] + n[y])
    return x[ok], y[ok], d[ok]


def scan(batches):
    """LISTS from entries (key, sid) sorted by both.

    Lists of 2 to ``SHORT`` sets are whole; longer ones, and the first and the
    last of a task, which may go on in another, are pieces of up to ``PIECE``.
    """
    first = True

    def out(keys, values, starts, lengths, whole):
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values[at]))
        return pa.RecordBatch.from_arrays([pa.array(keys[starts]), ids, pa.array(np.full(len(starts), whole))], names=["key", "ids", "whole"])

    def pieces(keys, values, starts, lengths):
        for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            cuts = np.arange(s, s + n, PIECE)
            yield out(keys, values, cuts, np.minimum(PIECE, s + n - cuts), False)

    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_ = None  # the key of a list of which pieces have gone out
    for b in batches:
        keys, values = (np.concatenate((h, b.column(i).to_numpy())) for i, h in enumerate(held))
        if not len(keys):
            continue
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        lengths = np.diff(np.append(starts, len(keys)))
        done, n = starts[:-1], lengths[:-1]
        short = n <= SHORT
        if len(done) and (first or keys[0] == open_):
            short[0] = False
        if len(done):
            first = False
            some = short & (n > 1)
            yield out(keys, values, done[some], n[some], True)
            yield from pieces(keys, values, done[~short], n[~short])
        last = int(starts[-1])
        held = keys[last:], values[last:]
        if len(held[0]) > PIECE:
            yield from pieces(*held, np.array([0]), np.array([len(held[0])]))
            open_, held = held[0][0], (held[0][:0], held[1][:0])
            first = False
    if len(held[0]):
        yield from pieces(*held, np.array([0]), np.array([len(held[0])]))


def jaccard_classes(docs: DataFrame, key: str, text: str, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    tuned(spark)
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def count(batches):
        hashes, total = WordHashes(), np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            held = [hashes.of(words_of(t)) for t in b.column(0).to_pylist()]
            if held:
                total += np.bincount(slots(np.concatenate(held)), minlength=len(total))
        at = np.flatnonzero(total)
        yield batch_of("slot int, n bigint", [at, total[at]])

    counts = base.select("text").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << SLOT_BITS)
    total[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    rarity = spark.sparkContext.broadcast(np.round(8 * np.log2(total + 1)).astype(np.uint16))

    def make(batches):
        sets = Sets(width, num, den, rarity.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = b.slice(at, 500).columns
                rows = [(k, *sets.row(t)) for k, t in zip(*(x.to_pylist() for x in c), strict=True)]
                yield batch_of(SETS, list(zip(*rows, strict=True)))

    made = written(base.mapInArrow(make, SETS), "sets")
    folded = made.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("entries").alias("entries"), F.first("flips").alias("flips"))
    own = written(folded.withColumn("sid", F.monotonically_increasing_id()), "own-sets")
    tidy(spark)

    def contents(asked: DataFrame) -> DataFrame:
        """(sid, grams) of the sets in column sid of ``asked``."""
        named = written(own.select("sid", F.col("set").alias("name"), "rep").join(asked, "sid", "left_semi"), "asked")
        sent = F.broadcast(named) if named.count() <= SENT else named
        same = (F.col("set") == F.col("name")) & F.col("doc_id").eqNullSafe(F.col("rep"))
        out = written(made.select("doc_id", "set", "grams").join(sent, same).select("sid", "grams").dropDuplicates(["sid"]), "grams")
        forget(named)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that link."""

        def check(batches):
            for b in batches:
                ids = [], []
                for a, c, x, y in zip(*(col.to_pylist() for col in b.columns), strict=True):
                    x, y = unpacked_keys(x), unpacked_keys(y)
                    small, large = (x, y) if len(x) < len(y) else (y, x)
                    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    same = int((large[at] == small).sum())
                    if (num + den) * same >= num * (len(x) + len(y)):
                        ids[0].append(a)
                        ids[1].append(c)
                yield batch_of("a bigint, b bigint", ids)

        held = contents(pairs.select(F.explode(F.array("a", "b")).alias("sid")))
        joined = pairs.join(held.select(F.col("sid").alias("b"), F.col("grams").alias("y")), "b").join(held.select(F.col("sid").alias("a"), F.col("grams").alias("x")), "a")
        out = written(joined.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), "edges")
        forget(held)
        return out

    def boundary() -> int:
        """The size up to which sets are light, from the lists of one key in ``MEASURED``."""
        most = most_light(num, den)
        small = {r.n: r["count"] for r in own.where(F.col("n") <= most).groupBy("n").count().collect()}
        if not small:
            return 0
        some = own.select(F.least("n", F.lit(most + 1)).alias("n"), F.explode("entries").alias("key")).where(F.pmod("key", F.lit(MEASURED)) == 0)
        by_size = some.groupBy("key", "n").agg(F.count("*").alias("c"))
        met = by_size.join(by_size.groupBy("key").agg(F.sum("c").alias("length")), "key").groupBy("n").agg(F.sum(F.col("c") * (F.col("length") - 1)).alias("met"))
        scans = {r.n: r.met * MEASURED for r in met.collect()}
        of = lambda x: np.array([x.get(n, 0) for n in range(most + 1)], np.float64)
        return choose_light(of(small), of(scans), num, den)

    light = boundary()

    def subsets(batches):
        for b in batches:
            for sid, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys = subset_keys(unpacked_keys(g), light, num, den).view(np.int64)
                yield batch_of("key bigint, sid bigint", [keys, np.full(len(keys), sid)])

    # heavy sets, and light ones that a heavy one may link to
    entries = own.where(F.col("n") * den >= num * (light + 1)).select(F.explode("entries").alias("key"), "sid")
    if light:
        small = contents(own.where(F.col("n") <= light).select("sid"))
        entries = written(entries.unionByName(small.select("sid", "grams").mapInArrow(subsets, "key bigint, sid bigint")), "entries")
        forget(small)
    lists = written(entries.repartitionByRange("key", "sid").sortWithinPartitions("key", "sid").mapInArrow(scan, LISTS), "lists")
    tidy(spark)
    pieces = lists.where("not whole")
    length = pieces.groupBy("key").agg(F.sum(F.size("ids")).alias("length"))
    rest = pieces.join(length.where(F.col("length") > 1), "key")
    mended = rest.where(F.col("length") <= SHORT).groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    short = lists.where("whole").select("ids").unionByName(mended.select("ids")).distinct()
    long_ = written(rest.where(F.col("length") > SHORT).select("key", "length", F.explode("ids").alias("sid")), "long-lists")
    # a set of long lists takes part in two of them, in one block each; a few stand in the next block too, as bridges
    blocks = F.ceil(F.col("length") / BLOCK).cast("long")
    block = F.pmod(F.xxhash64("sid"), blocks)
    bridge = F.when(F.pmod(F.xxhash64("sid", F.lit(1)), F.lit(32)) == 0, F.array(block, F.pmod(block + 1, blocks))).otherwise(F.array(block))
    ends = long_.groupBy("sid").agg(F.min(F.struct("key", "length")).alias("least"), F.max(F.struct("key", "length")).alias("most"))
    chosen = ends.select("sid", F.explode(F.array_distinct(F.array("least", "most"))).alias("l")).select("sid", "l.*").select("key", "sid", F.explode(F.array_distinct(bridge)).alias("block"))
    members = short.select(F.xxhash64("ids").alias("list"), F.explode("ids").alias("sid"), F.lit(False).alias("long")).unionByName(chosen.select(F.xxhash64("key", "block").alias("list"), "sid", F.lit(True).alias("long")))
    told = members.join(own.select("sid", "n", "flips"), "sid").select("list", "sid", "n", "flips", "long")

    def pairs(batches):
        for b in runs_of(batches):
            list_, sid, n = (b.column(i).to_numpy() for i in range(3))
            x, y, d = likely(n, Sketches(b.column(3).to_pylist()), *within(list_), num, den)
            order = np.lexsort((y, x, d, list_[x]))
            x, y = x[order], y[order]
            forest = Forest()
            tree = np.array([forest.join(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
            keep = tree | ~b.column(4).to_numpy(zero_copy_only=False)[x]
            x, y, tree = x[keep], y[keep], tree[keep]
            a, c = np.minimum(sid[x], sid[y]), np.maximum(sid[x], sid[y])
            yield batch_of(PAIRS, [a[a != c], c[a != c], tree[a != c]])

    named = written(told.repartition("list").sortWithinPartitions("list", "sid").mapInArrow(pairs, PAIRS).groupBy("a", "b").agg(F.max("tree").alias("tree")), "pairs")
    tidy(spark)
    component = connected(verified(named.where("tree").select("a", "b")))
    tidy(spark)

    # what is still apart: pairs of short lists across components
    of = lambda df, c: df.join(component.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in")), c, "left").withColumn(f"{c}_in", F.coalesce(f"{c}_in", c))
    apart = of(of(named.where("not tree").select("a", "b"), "a"), "b").where("a_in != b_in").select("a", "b")
    if not long_.isEmpty():
        # and in longer lists, sets outside the largest component against all others, block by block
        placed = of(long_, "sid").withColumnRenamed("sid_in", "home")
        each = placed.groupBy("key", "home").agg(F.count("*").alias("n"))
        most = each.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "home")).alias("m")).select("key", F.col("m.home").alias("main"), F.ceil(F.col("m.n") / BLOCK).alias("mains"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).alias("others"))
        some = placed.join(most.where("others > 0"), "key")
        block_of = lambda n: F.pmod(F.xxhash64("sid"), F.col(n))
        own_block, up_to = block_of("others"), lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        # a block pair is (kind, i, j): 0, others i against mains j; 1, others i against others j > i or, as side 2, among themselves
        pair = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
        inside = F.transform(up_to(F.col("others")), lambda i: pair(0, i, block_of("mains"), 1))
        outside = F.concat(
            F.transform(up_to(F.col("mains")), lambda j: pair(0, own_block, j, 0)),
            F.transform(F.filter(up_to(F.col("others")), lambda j: j > own_block), lambda j: pair(1, own_block, j, 0)),
            F.transform(F.filter(up_to(F.col("others")), lambda i: i < own_block), lambda i: pair(1, i, own_block, 1)),
            F.array(pair(1, own_block, own_block, 2)),
        )
        dealt = some.select("key", "sid", "home", F.explode(F.when(F.col("home") == F.col("main"), inside).otherwise(outside)).alias("p")).select(F.xxhash64("key", "p.kind", "p.i", "p.j").alias("list"), "sid", "home", "p.side", "key")
        # a pair is given in the least of its common lists alone; a set has fewer lists than shingles
        mine = long_.groupBy("sid").agg(F.collect_list("key").alias("keys"))
        faced = dealt.join(own.select("sid", "n", "flips").join(mine, "sid"), "sid").select("list", "sid", "n", "flips", "home", "side", "key", "keys")

        def across(batches):
            for b in runs_of(batches):
                list_, sid, n = (b.column(i).to_numpy() for i in range(3))
                home, side = b.column(4).to_numpy(), b.column(5).to_numpy()
                cuts = np.flatnonzero(np.append(True, list_[1:] != list_[:-1]))
                sketches, out = Sketches(b.column(3).to_pylist()), []
                key, keys = b.column(6).to_pylist(), [frozenset(x) for x in b.column(7).to_pylist()]
                for begin, end in zip(cuts, np.append(cuts[1:], len(list_)), strict=True):
                    one, two, three = (begin + np.flatnonzero(side[begin:end] == k) for k in range(3))
                    i, j = np.triu_indices(len(three), 1)
                    x, y = np.concatenate((np.repeat(one, len(two)), three[i])), np.concatenate((np.tile(two, len(one)), three[j]))
                    ok = (home[x] != home[y]) & (sid[x] != sid[y])
                    x, y, _ = likely(n, sketches, x[ok], y[ok], num, den)
                    here = np.array([min(keys[i] & keys[j]) == key[i] for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
                    x, y = x[here], y[here]
                    out += zip(np.minimum(sid[x], sid[y]).tolist(), np.maximum(sid[x], sid[y]).tolist(), strict=True)
                yield batch_of("a bigint, b bigint", list(zip(*set(out), strict=True)) or [[], []])

        apart = apart.unionByName(faced.repartition("list").sortWithinPartitions("list", "sid").mapInArrow(across, "a bigint, b bigint"))
    apart = written(apart.distinct(), "apart")
    if not apart.isEmpty():
        known = component
        component = connected(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(verified(apart)))
        forget(known)
        tidy(spark)
    classed = own.select("set", "rep", "sid").join(component, F.col("sid") == F.col("node"), "left").select("set", "rep", F.coalesce("component", "sid").alias("component"))
    least = classed.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = classed.join(least, "component").select("set", "component_id")
    out = made.select("doc_id", "n", "set").join(classes, "set", "left")
    out = written(out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")), "classes")
    for df in (made, own, entries, lists, long_, named, apart, component):
        forget(df)
    tidy(spark)
    return out


def op8(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
