"""LM scoring: stupid-backoff scores computed relationally over the corpus itself.

The score of a document is the sum over its words of ln S, with counts of all
other documents (its own are taken off, else nothing would ever back off):

    S(w | u v) = c(u v w) / c(u v)     where c(u v w) > 0
               = 0.4 * S(w | v)        otherwise
    S(w)       = c(w) / N, with 1 / 2 in place of c(w) = 0, and N the number of words

up to `order` words together; a word with fewer before it starts with those.

1. Documents are exploded into n-grams in blocks of about `block` words, and a block sends
   each distinct n-gram once, with how often it has it, to the n-gram's hash bucket.
2. Each bucket adds up its part of the count table, and answers each block.
3. Blocks and answers are joined by block, scores are taken, and summed per document.

Rows carry packed, sorted hashes of a block and bucket rather than one n-gram each: a
frequent n-gram takes one place a block, so no bucket is hot, and a task holds
one bucket's distinct n-grams or one block. A block ends after a document, so a very long
text is a block of its own, in memory whole. N-grams are told apart by 56 bits of hash.

Null texts and texts without words have 0 words, score 0 and a null mean; an empty table gives
no rows. Null ids and repeated rows stay rows of their own; repeated rows count each other as
other documents. Columns other than doc_id and text, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_part, rows, scramble, table, text_words

ALPHA = 0.4
_SHIFT = np.uint64(8)


def _zip(a: np.ndarray) -> bytes:
    """Bytes of each place together, so that the high ones of deltas vanish."""
    raw = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(len(raw), raw.itemsize).T.tobytes())


def _unzip(data: bytes, kind, n: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).ravel() if n else np.empty(0, kind)


def grams(unigram: np.ndarray, begins: np.ndarray, order: int):
    """For n from 1 to order: (hashes of the n words up to each place, the places that have as many
    words in their document). begins: of which document each place is, ascending."""
    g, ok = unigram, np.ones(len(unigram), bool)
    for n in range(1, order + 1):
        yield g, np.flatnonzero(ok)
        before = np.concatenate([[np.uint64(0)], g[:-1]])
        ok = ok & np.concatenate([[False], ok[:-1] & (begins[1:] == begins[:-1])]) if len(ok) else ok
        g = scramble(before * np.uint64(0x9E3779B97F4A7C15) + unigram) >> _SHIFT


def _counts(h: np.ndarray):
    return np.unique(h, return_counts=True)


_ROWS = "block long, bucket long, kind int, n long, hashes binary, counts binary"
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def _explode(docs: DataFrame, block: int, bits: int, order: int) -> DataFrame:
    """Rows of kind 1 to order (requests for n-grams, a bucket each), and of kind 0: a
    block's documents: hashes: places of words in its sorted words; counts: ids and lengths."""

    def run(batches):
        part, seq = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        held: list[np.ndarray] = []
        size = 0

        def out():
            number = part + seq
            lengths = np.array([len(x) for x in held], np.int64)
            h = np.concatenate([np.empty(0, np.uint64), *held])
            place = np.unique(h, return_inverse=True)[1]
            doc = np.repeat(np.arange(len(lengths)), lengths)
            asked = [_counts(g[at]) for g, at in grams(h, doc, order)]
            numbers = pa.array(ids, pa.int64())
            known = np.array([i is not None for i in ids], np.uint8)
            head = np.array([i or 0 for i in ids], np.int64).tobytes() + known.tobytes() + lengths.tobytes()
            made = [(number, -1, 0, len(h), _zip(place.astype(np.uint32)), np.int64(len(numbers)).tobytes() + head)]
            for kind, (g, c) in enumerate(asked, 1):
                bucket = (g >> np.uint64(56 - bits)).astype(np.int64)
                edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-2))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    made.append((number, int(bucket[a]), kind, b - a, _zip(np.diff(g[a:b], prepend=np.uint64(0))), _zip(c[a:b].astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _ARROW)], schema=_ARROW)

        for b in batches:
            numbers = b.column(0).to_pylist()
            for row, parts in text_words(b, True):
                for i, p in enumerate(parts):
                    ids.append(numbers[row + i])
                    held.append(p >> _SHIFT)
                    size += len(p)
                    if size >= block:
                        yield out()
                        ids, held, size, seq = [], [], 0, seq + 1
        if ids:
            yield out()

    return docs.mapInArrow(run, _ROWS)


def _answer(batches):
    """Sorted requests -> the same with the corpus's counts instead of the block's. For each bucket
    and kind, one pass builds its count table, and a second reads it."""
    held: list[tuple] = []
    last = None

    def flush():
        hashes = [np.cumsum(_unzip(r[4], np.uint64, r[3]), dtype=np.uint64) for r in held]
        every = np.concatenate(hashes)
        whole, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, np.concatenate([_unzip(r[5], np.uint32, r[3]) for r in held])).astype(np.int64)
        for r, h in zip(held, hashes):
            yield (*r[:4], r[4] if r[2] == 1 else None, _zip(total[np.searchsorted(whole, h)]))

    for cols in rows(batches, *_ARROW.names):
        for r in zip(*cols):
            if last != (r[1], r[2]) and held:
                yield _batch(flush())
                held = []
            last = (r[1], r[2])
            held.append(r)
    if held:
        yield _batch(flush())


def _batch(made) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), _ARROW)], schema=_ARROW)


def _rest(total: np.ndarray, doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Counts of each occurrence's item in the other documents."""
    key = doc * np.int64(len(total)) + item
    _, place, own = np.unique(key, return_inverse=True, return_counts=True)
    return total[item] - own[place]


def score_block(h: np.ndarray, lengths: np.ndarray, totals: list[np.ndarray], n: int) -> np.ndarray:
    """Sum of ln S of each document; totals: for words, pairs and so on the corpus's counts of the
    block's distinct ones, in order of hash."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    others = np.maximum(n - lengths, 1)[doc]
    s = context = None
    for (g, at), total in zip(grams(h, doc, len(totals)), totals):
        count = np.zeros(len(h), np.int64)
        count[at] = _rest(total, doc[at], np.unique(g[at], return_inverse=True)[1])
        if s is None:
            s = np.where(count > 0, count, 0.5) / others
        else:
            both = count[at]
            s[at] = np.where(both > 0, both / np.maximum(context[at - 1], 1), ALPHA * s[at])
        context = count
    out = np.zeros(len(lengths))
    np.add.at(out, doc, np.log(s))
    return out


def stupid_backoff(docs: DataFrame, order: int = 2, block: int = 1_000_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, log_score (sum of ln S), mean_log_score, with n-grams
    of up to `order` words."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = min(30, max(4, int(size / 4_000_000).bit_length()))  # buckets of about a million n-grams
    sent = cut(_explode(slim, block, bits, order), by="kind")
    n = int(sent.where("kind = 0").agg(F.sum("n")).first()[0] or 0)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    answers = cut(sent.where("kind > 0").select(*_ARROW.names).repartition(parts, "bucket", "kind").sortWithinPartitions("bucket", "kind").mapInArrow(_answer, _ROWS))
    blocks = spark.read.schema(sent.schema).option("basePath", sent._ringloom_path).parquet(f"{sent._ringloom_path}/kind=0") if n else sent.where("kind = 0")
    for kind in range(1, order + 1):  # answered
        drop_part(sent, f"kind={kind}")
    both = blocks.select(*_ARROW.names).unionByName(answers)

    def score(block_: pa.Table) -> pa.Table:
        got = sorted(zip(*(block_.column(c).to_pylist() for c in ("kind", "bucket", "n", "hashes", "counts"))), key=lambda r: r[:2])
        _, _, m, place, head = got[0]
        docs_ = int(np.frombuffer(head, np.int64, 1)[0])
        ids = np.frombuffer(head, np.int64, docs_, 8)
        known = np.frombuffer(head, np.uint8, docs_, 8 + 8 * docs_)
        lengths = np.frombuffer(head, np.int64, docs_, 8 + 9 * docs_)
        words = np.concatenate([np.empty(0, np.uint64), *(np.cumsum(_unzip(r[3], np.uint64, r[2]), dtype=np.uint64) for r in got if r[0] == 1)])
        total = [np.concatenate([np.empty(0, np.int64), *(_unzip(r[4], np.int64, r[2]) for r in got if r[0] == k)]) for k in range(1, order + 1)]
        h = words[_unzip(place, np.uint32, m)]
        sums = score_block(h, lengths, total, n)
        return pa.table({"doc_id": pa.array(ids, mask=known == 0), "n_words": lengths, "log_score": sums, "mean_log_score": pa.array(sums / np.maximum(lengths, 1), mask=lengths == 0)})

    out = both.groupBy("block").applyInArrow(score, "doc_id long, n_words long, log_score double, mean_log_score double")
    return out


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(table(spark, sf_dir, "documents"))
