"""What the corpus operators share: reading, words, hashing, written intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes that end a word, as in [^\x20\x09-\x0D]+.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text; bytes.split() cuts at just these six bytes."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that their order looks random."""
    h = (h ^ (h >> np.uint64(31))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PLAIN = scramble(np.arange(1, 257, dtype=np.uint64))
#: The same with A-Z as a-z.
_FOLDED = _PLAIN[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_PLACE = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, ends: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts that lie one after another in data (UTF-8 bytes), and
    the number of words up to the end of each text. ends: where each text ends.

    A word's hash is a sum, modulo 2^64, of a mixed number for each byte at each place in
    the word: two words have equal sums only by chance, however regular they are."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    space = _SPACE[data]
    inner = ~space
    first = inner.copy()
    first[1:] &= space[:-1]
    heads = ends[:-1][ends[:-1] < n]
    first[heads] = inner[heads]
    last = inner.copy()
    last[:-1] &= space[1:] | first[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    if not len(a):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    gap = np.diff(np.concatenate([[0], a, [n]]))
    place = np.arange(n) - np.repeat(np.concatenate([[0], a]), gap)
    each = scramble((_FOLDED if fold else _PLAIN)[data] + place.astype(np.uint64) * _PLACE)
    total = np.cumsum(each)
    return scramble(total[b] - total[a] + each[a]), np.searchsorted(a, ends)


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes of the rows one after another, where each ends) for slices of about
    size bytes of a column of strings or binaries; nulls are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        lo = offsets[row]
        yield row, data[lo : offsets[stop]], offsets[row + 1 : stop + 1] - lo
        row = stop


def text_words(batch: pa.RecordBatch, fold: bool, size: int = 2_000_000):
    """(first row, [word hashes of each row]) for slices of a batch of about size bytes;
    null texts have no words."""
    for row, data, ends in slices(batch.column(batch.schema.get_field_index("text")), size):
        h, upto = word_hashes(data, ends, fold)
        yield row, np.split(h, upto[:-1])


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbours, by doubling; empty when there are fewer than k."""
    if len(h) < k or k < 1:
        return np.empty(0, np.uint64)
    out, width, cur, span = None, 0, h, 1
    while span <= k:
        if k & span:
            out = cur if out is None else scramble(out[: len(h) - width - span + 1] * _B + cur[width : width + len(h) - width - span + 1])
            width += span
        if span * 2 <= k:
            cur = scramble(cur[: len(cur) - span] * _A + cur[span:])
        span *= 2
    return scramble(out)


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each Arrow batch as Python lists."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(b.schema.get_field_index(n)).to_pylist() for n in names)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where none is set, on a
    single machine."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not conf:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = getattr(spark.sparkContext, "_ringloom_dir", None) or "file://" + tempfile.mkdtemp(prefix="ringloom-")
        spark.sparkContext._ringloom_dir = conf
    return conf.rstrip("/")


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and
    a lost executor costs at most the tasks after it. by: a column with a folder for each value,
    so that drop_part can delete one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ringloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    _made.append((spark, path))
    schema = df.schema
    del df
    # what it shuffled is not needed any more: let Spark find that out now
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._ringloom_path = path
    return out


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most `most` rows in what runs meanwhile. A batch lies outside the JVM's heap, and
    twice while it grows: 10,000 texts or sets, Spark's default, are hundreds of MB for two tasks."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, min(before, most) if before > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_memory() -> None:
    """Give the system back what Arrow's and C's allocators hold free."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def thrifty(run: Callable) -> Callable:
    """run, for mapInArrow, after which its worker holds no free memory: Spark keeps workers for the tasks and
    stages to come, and what each holds idle is taken from them."""

    def freed(batches):
        try:
            yield from run(batches)
        finally:
            free_memory()

    return freed


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() made and nothing needs any more."""
    for t in tables:
        _delete(t.sparkSession, t._ringloom_path)


def drop_part(table_: DataFrame, part: str) -> None:
    """Delete a folder, e.g. kind=1, of a table that cut(..., by) made."""
    _delete(table_.sparkSession, f"{table_._ringloom_path}/{part}")


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Connected components of edges(a, b) of longs -> (node, component = smallest node).

    Labels go along edges and then to the label's own label, so that chains
    shorten by half a round. Each round is written out. Empty edges give no rows.
    """
    both = edges.where("a <> b").select("a", "b").distinct()
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("c")))
    for _ in range(most):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("m"))
        step = label.join(near, "node").select("node", "c", F.least("c", "m").alias("m"))
        hop = label.select(F.col("node").alias("m"), F.col("c").alias("far"))
        step = step.join(hop, "m", "left").select("node", F.col("c").alias("old"), F.least("m", F.coalesce("far", "m")).alias("c"))
        new = cut(step)
        done = new.where("c <> old").isEmpty()
        drop(label)
        label = new
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    return label.select("node", F.col("c").alias("component"))


def batches_of(table_rows: Iterable, schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of tuples."""
    held = []
    for r in table_rows:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
