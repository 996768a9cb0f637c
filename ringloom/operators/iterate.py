"""Fixpoints over DataFrames. Lineage is cut each round with a written table, which survives
lost executors and is compressed."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import both_ways


def _shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; a temporary one on a single machine only."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ringloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_made: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            return


def cut(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, deleted at exit. What df shuffled is not needed any
    more, and Spark is told to find that out."""
    spark = df.sparkSession
    path = f"{_shared_dir(spark)}/ringloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._ringloom_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() made and nothing needs any more."""
    for t in tables:
        _delete(t.sparkSession, t._ringloom_path)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], changed: Callable[[DataFrame], bool], most: int) -> DataFrame:
    """state = step(state) until changed(state) is false; raises after `most` rounds."""
    state = cut(state)
    for _ in range(most):
        state = cut(step(state))
        if not changed(state):
            return state
    raise RuntimeError(f"no fixpoint after {most} rounds")


def components(edges: DataFrame, nodes: DataFrame | None = None, most: int = 60) -> DataFrame:
    """user_id, component: the smallest id that edges(src, dst) connect; nodes(user_id) adds
    isolated ones. Labels go to neighbours and then to the label's own label."""
    ways = cut(both_ways(edges.select("src", "dst")).where("node <> nbr").distinct())
    every = ways.select(F.col("node").alias("user_id")).distinct()
    if nodes is not None:
        every = every.union(nodes.select("user_id")).distinct()
    start = every.select("user_id", F.col("user_id").alias("c"), F.lit(True).alias("moved"))

    def step(s: DataFrame) -> DataFrame:
        label = s.select("user_id", "c")
        near = ways.join(label.withColumnRenamed("user_id", "nbr"), "nbr").groupBy(F.col("node").alias("user_id")).agg(F.min("c").alias("m"))
        low = label.join(near, "user_id", "left").select("user_id", "c", F.least("c", "m").alias("m"))
        far = label.select(F.col("user_id").alias("m"), F.col("c").alias("f"))
        return low.join(far, "m", "left").select("user_id", F.least("m", "f").alias("n"), "c").select("user_id", F.col("n").alias("c"), (F.col("n") < F.col("c")).alias("moved"))

    done = iterate(start, step, lambda s: not s.where("moved").isEmpty(), most)
    return done.select("user_id", F.col("c").alias("component"))


def known(df: DataFrame, sent: int = 1_000_000) -> DataFrame:
    """df, written, to join with more rows than it has: up to `sent` rows (counted) are broadcast."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= sent else df


def _peeled_cores(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Core numbers of places 0..n-1; each pair a < b is there once."""
    sides = []
    for x, y in ((a, b), (b, a)):
        first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))])
        sides.append((first, y[np.argsort(x, kind="stable")]))
    degree = sum(np.diff(first) for first, _ in sides)
    core, open_, k = np.zeros(n, np.int64), np.arange(n), 0
    while len(open_):
        k = max(k, int(degree[open_].min()))
        go = open_[degree[open_] <= k]
        while len(go):
            core[go] = k
            degree[go] = np.iinfo(np.int64).max // 2
            near = [y[np.repeat(first[go] - np.cumsum(m) + m, m) + np.arange(m.sum())] for first, y in sides for m in [first[go + 1] - first[go]]]
            hit, lost = np.unique(np.concatenate(near), return_counts=True)
            degree[hit] -= lost
            go = hit[degree[hit] <= k]
        open_ = open_[degree[open_] < np.iinfo(np.int64).max // 4]
    return core


def core_numbers(edges: DataFrame, most: int = 200, small: int = 30_000_000) -> DataFrame:
    """user_id, core_number. A graph of up to `small` edges (counted) is peeled in one task; in a larger one each node takes the
    h-index of its neighbours' values, from its degree down, until nothing changes. edges may be repeated or either way round."""
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    pairs = cut(edges.where("src <> dst").select(low, high))
    if pairs.count() <= small:

        def run(batches):
            parts = [[c.to_numpy() for c in b.columns] for b in batches]
            parts = [[c.astype(np.int32) if len(c) and -(2**31) <= c.min() and c.max() < 2**31 else c for c in p] for p in parts]
            if not parts:
                return
            a, b = (np.concatenate(x) for x in zip(*parts))
            del parts
            ids = np.union1d(a, b)
            a, b = np.searchsorted(ids, a).astype(np.int32), np.searchsorted(ids, b).astype(np.int32)
            if len(a) > 1:
                key = a.astype(np.int64) * len(ids) + b
                key.sort()
                key = key[np.concatenate([[True], np.diff(key) != 0])]
                a, b = (key // len(ids)).astype(np.int32), (key % len(ids)).astype(np.int32)
                del key
            core = _peeled_cores(a, b, len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(core)], ["user_id", "core_number"])

        return cut(pairs.select(F.col("src").cast("long"), F.col("dst").cast("long")).coalesce(1).mapInArrow(run, "user_id long, core_number long"))
    ways = cut(both_ways(pairs).distinct())
    start = ways.groupBy(F.col("node").alias("user_id")).agg(F.count("*").alias("core_number")).withColumn("moved", F.lit(True))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("v")))

    def step(s: DataFrame) -> DataFrame:
        near = ways.join(s.select(F.col("user_id").alias("nbr"), F.col("core_number").alias("v")), "nbr")
        h = near.withColumn("r", rank).groupBy(F.col("node").alias("user_id")).agg(F.max(F.least("v", "r")).cast("long").alias("h"))
        return s.join(h, "user_id").select("user_id", F.least("core_number", "h").alias("core_number"), (F.col("h") < F.col("core_number")).alias("moved"))

    return iterate(start, step, lambda s: not s.where("moved").isEmpty(), most).drop("moved")


def propagation_constants(h: float) -> tuple[float, float]:
    """(a, c') of linearised belief propagation; homophily must keep 4 h^2 below 1."""
    if 4 * h * h >= 1:
        raise ValueError("homophily too large")
    return 4 * h * h / (1 - 4 * h * h), 2 * h / (1 - 4 * h * h)


def convergence_bound(degrees: DataFrame) -> float:
    """The largest homophily that either norm's bound guarantees. degrees(d)."""
    r = degrees.agg(F.max("d").alias("m"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"), F.count("*").alias("n")).first()
    if not r.n:
        return 0.5
    one = 1 / (2 + 2 * r.m)
    c1, c2 = 2 + r.s, r.q - 1
    frobenius = ((-c1 + (c1 * c1 + 4 * c2) ** 0.5) / (8 * c2)) ** 0.5 if c2 > 0 else 0.0
    return max(one, frobenius)


def choose_homophily(bound: float, lift: float) -> float:
    return max(min(0.5 * (1 - 1 / lift), bound * (1 - 1e-6)), 0.0) if lift > 0 else 0.0


def propagate(edges: DataFrame, prior: DataFrame, h: float, rounds: int | None = None, tolerance: float = 1e-6, most: int = 500, sent: int = 1_000_000) -> DataFrame:
    """user_id, belief: prior(user_id, phi) spread over edges(src, dst, weight) by
    b = phi + c' A b - a D b, summed as a power series until terms fall below the tolerance,
    or for a fixed number of rounds. Beliefs are shifted to 0.5 for none. Edges are written once; the terms of up
    to `sent` accounts (counted) are broadcast to them, and more are joined, which deals all edges in each round."""
    a, c = propagation_constants(h)
    ways = both_ways(cut(edges.select("src", "dst", "weight"))).withColumn("weight", F.col("weight").cast("double"))
    degree = ways.groupBy(F.col("node").alias("user_id")).agg(F.sum("weight").alias("d"))
    state = cut(prior.join(degree, "user_id", "left").select("user_id", F.coalesce("d", F.lit(0.0)).alias("d"), F.col("phi").cast("double").alias("b"), F.col("phi").cast("double").alias("term")))
    to_all = F.broadcast if state.count() <= sent else lambda df: df
    for i in range(rounds if rounds is not None else most):
        near = ways.join(to_all(state.select(F.col("user_id").alias("nbr"), "term")), "nbr").groupBy(F.col("node").alias("user_id")).agg(F.sum(F.col("weight") * F.col("term")).alias("x"))
        new = F.coalesce("x", F.lit(0.0)) * c - a * F.col("d") * F.col("term")
        state = cut(state.join(near, "user_id", "left").withColumn("new", new).select("user_id", "d", (F.col("b") + F.col("new")).alias("b"), F.col("new").alias("term")))
        if rounds is None and (state.agg(F.max(F.abs("term"))).first()[0] or 0.0) < tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError("propagation did not converge")
    return state.select("user_id", (F.col("b") + 0.5).alias("belief"))


def bipartite(capped_: DataFrame, base: float = 2.0) -> DataFrame:
    """Account-entity edges: src account, dst entity node (a negative id), weight by rarity."""
    entity = -(F.abs(F.xxhash64("rel", "entity")) % F.lit(2**62)) - 1
    return capped_.select(F.col("user_id").alias("src"), entity.alias("dst"), (1 / F.log(base + F.col("size"))).alias("weight"), "rel", "entity")
