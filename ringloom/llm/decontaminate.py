"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of characters other than ASCII white space and
punctuation. Each n-gram of a test item is a seed. One scan of the documents
finds places where two or more seeds of one item lie together, and counts the
documents of every seed. A seed is rare unless it is in over `common` times as
many documents as the median seed of its item: at least half of every item's
seeds are rare, so neither an item of everyday words nor one that leaked into a
third of all documents escapes. Places with rare seeds are aligned with the
item by Smith-Waterman (match 2, mismatch -1, gap -1), and the score is divided
by that of a perfect copy.

Test items are taken in blocks of `block`, each one scan: what a task holds in
memory is bounded by the block. Nulls: null texts and items have no words; rows
without an id are ignored, as a leak must be named. Repeated rows of one doc_id
give one result, their best. Items of fewer than n words are one seed, and must
be found whole.
"""

from __future__ import annotations

import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, batches_of, cut, rows, table, thrifty

_FOLD = bytes(32 if chr(b) in string.punctuation or b < 33 or b == 127 else b for b in range(256))


def folded(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def grams(words: list[bytes], n: int):
    return zip(*(words[i:] for i in range(n)))


def align(a: list[bytes], b: list[bytes]) -> tuple[int, int, int, int]:
    """Smith-Waterman of words: (score, equal words, first and end word in b)."""
    code: dict[bytes, int] = {}
    x = np.array([code.setdefault(w, len(code)) for w in a])
    y = [code.get(w, -1) for w in b]
    m = len(x)
    score, start, same = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    best = (0, 0, 0, 0)
    step = np.arange(m + 1)
    for j, w in enumerate(y):
        hit = x == w
        diag = score[:-1] + np.where(hit, 2, -1)
        up = score[1:] - 1
        fresh = np.concatenate([[0], np.maximum(np.maximum(diag, up), 0)])
        begin = np.concatenate([[j + 1], np.where((diag >= up) & (diag > 0), np.where(score[:-1] > 0, start[:-1], j), np.where(up > 0, start[1:], j + 1))])
        equal = np.concatenate([[0], np.where((diag >= up) & (diag > 0), np.where(score[:-1] > 0, same[:-1], 0) + hit, np.where(up > 0, same[1:], 0))])
        # gaps in b: the running best to the left, less one a step
        left = np.maximum.accumulate(fresh + step) - step
        at = np.maximum.accumulate(np.where(fresh == left, step, 0))
        score, start, same = left, begin[at], equal[at]
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), int(same[k]), int(start[k]), j + 1)
    return best


_HITS = "seed int, n long, doc_id long, item int, seeds array<int>, first long, words binary"


class Seeds:
    """The seeds of a block of items, numbered, with the items that hold them."""

    def __init__(self, items: list[list[bytes]], n: int):
        self.n, self.items = n, items
        self.number: dict[tuple, int] = {}
        self.of: dict[tuple, tuple[int, ...]] = {}
        self.seeds: list[list[int]] = []
        held = defaultdict(list)
        for i, words in enumerate(items):
            k = min(n, len(words))
            mine = dict.fromkeys(grams(words, k)) if k else {}
            self.seeds.append([self.number.setdefault(g, len(self.number)) for g in mine])
            for g in mine:
                held[g].append(i)
        self.of = {g: tuple(v) for g, v in held.items()}
        self.widths = sorted({len(g) for g in self.of})

    def find(self, words: list[bytes]):
        """[(position, seed, items)] of all seeds in words."""
        get, out = self.of.get, []
        for k in self.widths:
            out += [(p, g) for p, g in enumerate(grams(words, k)) if g in self.of] if k != self.n else [(p, g) for p, g in enumerate(zip(words, *(words[i:] for i in range(1, k)))) if g in self.of]
        return [(p, self.number[g], get(g)) for p, g in out]


def _places(found, seeds: Seeds):
    """(item, seed numbers, first, end) where an item's seeds lie together."""
    by = defaultdict(list)
    for p, s, items in found:
        for i in items:
            by[i].append((p, s))
    for i, hits in by.items():
        length = len(seeds.items[i])
        need = min(2, len(seeds.seeds[i]))
        hits.sort()
        run = [hits[0]]
        for h in [*hits[1:], None]:
            if h is not None and h[0] - run[-1][0] <= length:
                run.append(h)
                continue
            if len({s for _, s in run}) >= need:
                yield i, sorted({s for _, s in run}), max(0, run[0][0] - length), run[-1][0] + length + seeds.n
            run = [h]


def _scan(docs: DataFrame, seeds: Seeds) -> DataFrame:
    schema = pa.schema([("seed", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("item", pa.int32()), ("seeds", pa.list_(pa.int32())), ("first", pa.int64()), ("words", pa.binary())])

    @thrifty
    def run(batches):
        df: dict[int, int] = defaultdict(int)

        def hits():
            for ids, texts in rows(batches, "doc_id", "text"):
                for d, t in zip(ids, texts):
                    words = folded(t)
                    found = seeds.find(words)
                    if not found:
                        continue
                    for s in {s for _, s, _ in found}:
                        df[s] += 1
                    for i, mine, a, b in _places(found, seeds):
                        yield None, None, d, i, mine, a, b" ".join(words[a:b])

        yield from batches_of(hits(), schema, 2000)
        yield from batches_of(((s, n, None, None, None, None, None) for s, n in df.items()), schema)

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, common: float = 8.0, least: float = 0.5, block: int = 100_000) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, score, equal_words,
    first_word, end_word: one row for each document and item whose best alignment scores
    least or more of a perfect copy's. Other columns are not looked at."""
    spark = docs.sparkSession
    ids = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = []
    low = None
    while True:
        part = ids if low is None else ids.where(F.col("item_id") > low)
        got = part.orderBy("item_id", "text").limit(block).collect()
        if not got:
            break
        low = got[-1].item_id
        if len(got) == block:  # rows that share the last id stay together
            got = [r for r in got if r.item_id != low] + part.where(F.col("item_id") == low).collect()
        out.append(_block(docs, [r.item_id for r in got], [folded(r.text) for r in got], n, common, least))
        if len(got) < block:
            break
    if not out:
        return spark.createDataFrame([], _FOUND)
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    best = F.max(F.struct("score", "equal_words", (-F.col("first_word")).alias("f"), (-F.col("end_word")).alias("e"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.equal_words", (-F.col("b.f")).alias("first_word"), (-F.col("b.e")).alias("end_word"))


_FOUND = "doc_id long, item_id long, score double, equal_words long, first_word long, end_word long"


def _block(docs: DataFrame, ids: list[int], items: list[list[bytes]], n: int, common: float, least: float) -> DataFrame:
    seeds = Seeds(items, n)
    with arrow_rows(docs.sparkSession, 1_000):
        hits = cut(_scan(docs, seeds))
    counted = {r.seed: r.n for r in hits.where("seed is not null").groupBy("seed").agg(F.sum("n").alias("n")).collect()}  # at most the block's seeds
    rare: list[frozenset[int]] = []
    for mine in seeds.seeds:
        many = [counted.get(s, 0) for s in mine]
        cap = common * float(np.median([m for m in many if m] or [0]))
        rare.append(frozenset(s for s, m in zip(mine, many) if m <= cap))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("equal_words", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64())])

    @thrifty
    def verify(batches):
        def found():
            for docs_, item, mine, first, words in rows(batches, "doc_id", "item", "seeds", "first", "words"):
                for d, i, s, f, w in zip(docs_, item, mine, first, words):
                    if rare[i].isdisjoint(s):
                        continue
                    score, same, a, b = align(items[i], w.split(b" "))
                    if score >= least * 2 * len(items[i]):
                        yield d, ids[i], score / (2 * len(items[i])), same, f + a, f + b

        return batches_of(found(), schema)

    return hits.where("item is not null").select("doc_id", "item", "seeds", "first", "words").repartition("doc_id", "first").mapInArrow(verify, _FOUND)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, whose doc_id no test item leaked into. The leaks
    are found first and written; as many as there are leaking documents are joined."""
    found = cut(contaminated(docs, benchmark).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
