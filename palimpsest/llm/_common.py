"""Shared folder, hashing and component helpers of the llm operators."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker keeps in its word cache before it starts afresh.
CACHE_WORDS = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share.

    Read from ``spark.checkpoint.dir``; a temporary one is made only where the
    setting is absent and the session is local, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def tuned(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, so that a worker's memory stays bounded on long texts; kept if set already."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


class _Made(threading.local):
    """Paths of the tables that this thread wrote and did not delete since."""

    def __init__(self):
        self.paths: dict[str, None] = {}


_made = _Made()


def scratch(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.paths[path] = None
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _made.paths.pop(path, None)


def forget(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    path = getattr(df, "_palimpsest_path", None)
    if path:
        _delete(df.sparkSession, path)


def made() -> list[str]:
    """This thread's tables that stand now; what a lazy result reads is among those made since an earlier call."""
    return list(_made.paths)


def drop(spark: SparkSession, earlier: list[str], *kept: DataFrame) -> None:
    """Delete all tables made since ``earlier = made()``, but those given, once the results over them are written."""
    keep = {*earlier, *(getattr(df, "_palimpsest_path", None) for df in kept)}
    for path in made():
        if path not in keep:
            _delete(spark, path)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


class WordHashes(dict):
    """64-bit hashes of byte words, remembered up to ``CACHE_WORDS`` entries."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, as UTF-8 bytes."""
    return text.encode().lower().split() if text else []


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads sums and products of hashes."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(salt) * MIX
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of ``width`` words; the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    with np.errstate(over="ignore"):
        out = words[: n - width + 1].copy()
        for k in range(1, width):
            out = out * MIX + words[k : n - width + 1 + k]
        return mixed(out, width)


def planes(values: np.ndarray) -> bytes:
    """Integers as byte planes: the planes of high bytes are mostly equal and compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, np.uint64), dtype=np.uint64)


def runs_of(batches, column: int = 0):
    """Batches sorted by a column, dealt anew so that none of its values spans two."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        end = int(np.searchsorted(keys, keys[-1]))
        held = batch.slice(end)
        if end:
            yield batch.slice(0, end)
    if held is not None:
        yield held


def table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """An Arrow batch of rows; ``schema`` lists name:type pairs of Arrow type aliases."""
    fields = [x.split(":") for x in schema.split()]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary(), "bool": pa.bool_(), "longs": pa.list_(pa.int64())}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def ddl(schema: str) -> str:
    kinds = {"long": "bigint", "bool": "boolean", "longs": "array<bigint>"}
    return ", ".join(f"{n} {kinds.get(t, t)}" for n, t in (x.split(":") for x in schema.split()))


class Forest(dict):
    """Union-find over any orderable nodes; a root is the least node joined to it."""

    def root(self, x):
        top = x
        while (up := self.get(top, top)) != top:
            top = up
        while x != top:
            self[x], x = top, self.get(x, x)
        return top

    def join(self, x, y) -> bool:
        """Whether x and y were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


#: Edges that one task folds at a time before they are sent on.
FOLD = 200_000


def _folded(batches):
    """Edges (a, b) as stars around the least node that each run of ``FOLD`` edges joins."""
    kind, forest, n = None, Forest(), 0

    def stars():
        rows = [(x, r) for x in forest if (r := forest.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(x, y)
        n += batch.num_rows
        if n > FOLD:
            yield stars()
            forest.clear()
            n = 0
    if n:
        yield stars()


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """Components of an undirected graph, as (node, component): the least node reachable.

    ``edges`` has columns a and b of one orderable type.  Tasks first fold
    runs of edges into stars by union-find, then the large-star and small-star
    steps alternate until every node hangs on one root; each round is written
    to the shared folder and one row returns to the driver.  A hub's rows are
    folded by partial min() before the shuffle, and the join back to them is
    split by adaptive execution.
    """
    kind = f"a {edges.schema['a'].dataType.simpleString()}, b {edges.schema['a'].dataType.simpleString()}"
    now = written(edges.select("a", "b").mapInArrow(_folded, kind).distinct(), label)
    while True:
        ends = now.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        loose = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0")
        if loose.isEmpty():
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out._palimpsest_path = now._palimpsest_path
            return out
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b")
        new = written(small.mapInArrow(_folded, kind).distinct(), label)
        forget(now)
        now = new
