"""N-gram Jaccard join: prefix filters under several global token orders.

A document's set holds its distinct word shingles. If two sets' Jaccard index
is t% or more, they share a token among the first p = n - ceil(t n / 100) + 1 of
each, under every global order of tokens. So a document with p tokens at the front
of an order that no other document has is linked with nothing. The orders:

1. Over all documents: tokens of a fixed part of the hash space that only one document
   has come first. Only that part of the tokens is counted.
2. and 3. Over the documents left, one for each set: tokens in fewer documents
   first, ties in two different random orders. Everyday phrases and passages that
   many documents share come last, where they bring nothing together.

Under each of the last two, documents that share a prefix token are connected, and
the connected sets of both are intersected: every candidate pair lies in one such
class, so classes are searched apart from each other, and no pairs are ever
written. Within a class, a breadth-first search takes as a document's candidates those, not
reached yet, that share a prefix token with it under one order and under the other, and verifies
the candidates' whole sets. A class beyond `block` tokens is split into blocks, each pair
of which is one task, and the links found are connected at the end.

Empty tables give no rows. Repeated rows count once. Texts of any length are one set in memory
of one task; columns other than doc_id and text, whatever their names, are not looked at.
Nulls: null texts and texts without words are linked with nothing; rows with a
null doc_id give no row. Of several texts of one doc_id, the one with the most
shingles counts (ties: the larger hash).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, components, cut, drop, gram_hashes, scramble, signed, table, text_words, thrifty


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a shorter text is one shingle as a whole."""
    if not len(h):
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(h, k) if len(h) >= k else gram_hashes(h, len(h)) ^ np.uint64(len(h)))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate([np.empty(0, np.uint64), *parts]))))


def _first_look(docs: DataFrame, k: int, share: int) -> DataFrame:
    """doc_id, n, fp (128 bits of the set), tokens: one in `share` of the hash space."""

    @thrifty
    def run(batches):
        for b in batches:
            ids = b.column(0)
            for row, parts in text_words(b, True):
                sets = [shingles(h, k) for h in parts]
                some = [s[scramble(s) % np.uint64(share) == 0] for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(parts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), _lists(some)], ["doc_id", "n", "fp", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n long, fp binary, tokens array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """docs(doc_id, text, fp) -> doc_id, tokens: the whole set, where it is the one of fp."""

    @thrifty
    def run(batches):
        for b in batches:
            ids, fps = b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("fp")).to_pylist()
            for row, parts in text_words(b, True):
                sets = [shingles(h, k) for h in parts]
                keep = [i for i, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == fps[row + i]]
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(parts)).take(pa.array(keep, pa.int64())), _lists([sets[i] for i in keep])], ["doc_id", "tokens"])

    return docs.mapInArrow(run, "doc_id long, tokens array<long>")


#: What a token is mixed with under each of the two random orders.
_SEEDS = (np.uint64(0), np.uint64(0xA0761D6478BD642F))


def _fronts(lists: DataFrame) -> DataFrame:
    """lists(doc_id, length, shared: (df, token) pairs) -> doc_id, p0, p1: the first `length` tokens under
    each random order. Sorted in arrays: as sorted lists of rows they filled the executors' memory."""

    @thrifty
    def run(batches):
        for b in batches:
            shared, lengths = b.column(2), b.column(1).to_numpy()
            ends = shared.offsets.to_numpy()
            df, token = (shared.values.field(i).to_numpy() for i in (0, 1))
            token = token.view(np.uint64)
            out: tuple = ([], [])
            for a, z, k in zip(ends[:-1].tolist(), ends[1:].tolist(), lengths.tolist()):
                for seed, to in zip(_SEEDS, out):
                    to.append(token[a:z][np.lexsort((scramble(token[a:z] ^ seed), df[a:z]))[:k]])
            yield pa.RecordBatch.from_arrays([b.column(0), *map(_lists, out)], ["doc_id", "p0", "p1"])

    return lists.mapInArrow(run, "doc_id long, p0 array<long>, p1 array<long>")


def _connected(sets: DataFrame, column: str) -> DataFrame:
    """Documents that share a token of the column, connected: (doc_id, c). Others are left out."""
    tokens = sets.select("doc_id", F.explode(column).alias("token"))
    shared = tokens.groupBy("token").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("z")).where("b <> z").select("token", "b")
    edges = cut(tokens.join(shared, "token").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct())
    found = components(edges)
    drop(edges)
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("c"))


def _postings(lists: list[np.ndarray]):
    """(code of each list's values one after another, where each list ends, owners by code, where
    each code's owners begin)."""
    n = np.array([len(x) for x in lists])
    code = np.unique(np.concatenate(lists), return_inverse=True)[1]
    owner = np.repeat(np.arange(len(lists)), n)[np.argsort(code, kind="stable")]
    return code, np.concatenate([[0], np.cumsum(n)]), owner, np.concatenate([[0], np.cumsum(np.bincount(code))])


def _search(h: list[np.ndarray], prefixes: list[list[np.ndarray]], ids: np.ndarray, t: int) -> np.ndarray:
    """For each set the smallest id that links lead to: breadth first, each set compared only with
    those not reached yet whose prefixes meet its own under every order."""
    n = np.array([len(x) for x in h])
    code, ends, _, begin = _postings(h)
    orders = [_postings(p) for p in prefixes]
    left = np.ones(len(h), bool)
    group = np.arange(len(h))
    marks = np.zeros(len(begin) - 1, bool)
    for root in range(len(h)):
        if not left[root]:
            continue
        left[root] = False
        queue, members = [root], [root]
        while queue:
            i = queue.pop()
            open_ = left & (100 * n >= t * n[i]) & (100 * n[i] >= t * n)
            for c, e, owner, first in orders:
                met = np.zeros(len(h), bool)
                for x in c[e[i] : e[i + 1]].tolist():
                    met[owner[first[x] : first[x + 1]]] = True
                open_ &= met
            open_ = np.flatnonzero(open_)
            if not len(open_):
                continue
            mine = code[ends[i] : ends[i + 1]]
            marks[mine] = True
            both = np.array([np.count_nonzero(marks[code[ends[j] : ends[j + 1]]]) for j in open_.tolist()])
            marks[mine] = False
            near = open_[100 * both >= t * (n[i] + n[open_] - both)]
            left[near] = False
            queue += near.tolist()
            members += near.tolist()
        group[members] = ids[members].min()
    return group


def _prefix(n, t: int):
    return n - F.ceil(n * t / 100).cast("long") + 1


def jaccard_components(docs: DataFrame, k: int = 5, t: int = 80, block: int = 3_000_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: one row for each non-null
    doc_id, component_id the smallest id reachable over links of Jaccard t% or more between
    sets of k-word shingles. block: tokens that one task holds of a class, twice at most.
    Other columns are not looked at."""
    with arrow_rows(docs.sparkSession, 1_000):
        return _components(docs, k, t, block)


def _components(docs: DataFrame, k: int, t: int, block: int) -> DataFrame:
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    look = cut(_first_look(docs, k, max(1, 60 // (100 - t)) if t < 100 else 60))
    alone = look.select("doc_id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))
    one = look.groupBy("doc_id").agg(F.max(F.struct("n", "fp")).alias("s"), F.count("*").alias("texts")).select("doc_id", "s.n", "s.fp", "texts")
    near = cut(one.join(alone, "doc_id", "left").select("doc_id", "n", "fp", (F.col("n") > 0).alias("any"), ((F.col("texts") > 1) | (F.coalesce("alone", F.lit(0)) < _prefix(F.col("n"), t))).alias("left")))
    drop(look)
    copies = near.where("any").groupBy("fp").agg(F.min("doc_id").alias("b"), F.count("*").alias("c"), F.first("n").alias("n"), F.max("left").alias("left"))
    copied = near.where("any").select(F.col("doc_id").alias("a"), "fp").join(copies.where("c > 1").select("fp", "b"), "fp").select("a", "b").where("a <> b")
    chosen = copies.where("left").select(F.col("b").alias("doc_id"), "fp")
    sets = cut(_sets(docs.join(chosen, "doc_id"), k).dropDuplicates(["doc_id"]))
    tokens = sets.select("doc_id", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    front = tokens.join(often, "token").groupBy("doc_id").agg(F.collect_list(F.struct("df", "token")).alias("shared"))
    front = front.join(sets.select("doc_id", F.size("tokens").cast("long").alias("n")), "doc_id")
    length = _prefix(F.col("n"), t) - (F.col("n") - F.size("shared"))
    front = cut(_fronts(front.withColumn("length", length).where("length > 0").select("doc_id", "length", "shared")))
    classes = None
    for j in (0, 1):
        pool = front.select("doc_id", f"p{j}")
        if classes is not None:
            pool = pool.join(classes.select("doc_id"), "doc_id", "left_semi")
        found = _connected(pool, f"p{j}").withColumnRenamed("c", f"c{j}")
        classes = found if classes is None else classes.join(found, "doc_id")
    member = cut(sets.join(classes, "doc_id").join(front, "doc_id"))
    drop(sets, front)
    size = member.groupBy("c0", "c1").agg(F.count("*").alias("m"), F.sum(F.size("tokens")).alias("all")).where("m > 1").select("c0", "c1", F.ceil(F.col("all") / block).cast("int").alias("blocks"))
    verify = member.join(size, ["c0", "c1"]).withColumn("mine", F.pmod(F.hash("doc_id"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    verify = verify.select("doc_id", "tokens", "p0", "p1", "c0", "c1", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def linked(class_: pa.Table) -> pa.Table:
        ids = class_.column("doc_id").to_numpy()
        sets_, *prefixes = ([x for c in class_.column(name).chunks for x in _split(c)] for name in ("tokens", "p0", "p1"))
        return pa.table({"a": pa.array(ids), "b": pa.array(_search(sets_, prefixes, ids, t))})

    found = verify.groupBy("c0", "c1", "i", "j").applyInArrow(linked, "a long, b long")
    links = cut(found.where("a <> b").unionByName(copied).distinct())
    whole = components(links)
    drop(member, links)
    return near.join(whole, near.doc_id == whole.node, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _split(c: pa.ListArray) -> list[np.ndarray]:
    values, offsets = c.values.to_numpy(), c.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, t=90)


def one_of_each(docs: DataFrame, k: int = 5, t: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all columns.
    Rows without an id stay."""
    gone = jaccard_components(docs, k, t).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
