"""What the two exact substring deduplications share: from documents to the places
where repeats can be, and back.

A text is a row of symbols (words or bytes), and a window is `width` of them in
a row. Every window has an anchor: the leftmost of the runs of `k` symbols
inside it whose number is smallest. Equal windows have equal anchors, so a window
whose anchor is found once in the whole corpus occurs once. That leaves the
windows of recurring anchors, and they are compared in passes:

1. One scan gives the distinct anchors of each document, with how often and where first it has
   them. They are added up, and a recurring anchor is routed by the smallest
   document that has it and the first block of `block` symbols in which a document does, so
   neighbouring anchors of copies keep together. All windows of an anchor go the same way, so
   equal ones meet.
2. Each document finds its recurring anchors again and cuts its segments: the text of neighbouring
   windows of a route. Of equal segments
   in a batch only the first is sent on, before the shuffle; the others' windows all start
   earlier there. A route of over `heavy` occurrences is dealt into parts by segment, so no route,
   group of copies or long document has to fit in one task.
3. A kernel (automata for words, suffix arrays for bytes) takes shards of
   segments and says which windows also start earlier in their shard. What these
   cover is written as spans, neighbours joined.
4. Of a route with several parts, the windows that are first in their part are left:
   copies are gone, so less of them is. They are the next pass's input, with longer
   anchors, so that a common phrase in ever other surroundings falls apart; in the last pass a
   window is its own anchor and its own route, of which each part has one at most.
5. Spans come back to their documents.

Every window is compared with all equal ones at any size; `heavy` only says how many
tasks take part.

"Earlier" is (doc_id, start) in ascending order. Rows without a doc_id are
earlier than nothing and keep all they have. Repeated rows of one doc_id are at
the same place, so they don't remove each other; with different texts they
are compared with other documents by their common doc_id. Null and empty texts
have no symbols. Other columns are not looked at. A long text is one row; its list of anchors
has an entry for about each (width - k) / 2 symbols, its list of spans one for each `width` at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, cut, drop, scramble, signed

@dataclass(frozen=True)
class Kind:
    """width: symbols of a window; ks: symbols of an anchor in each pass, the last `width`;
    hashes(binary column) -> slices (first row, hashes of all symbols, ends of the rows in
    them); split(bytes) -> units and join(units) -> bytes, one the other's inverse; kernel(segments)
    -> (where each segment's symbols end, whether the window from each symbol on is whole, and
    whether it also starts earlier), of [((doc_id, copy), start, bytes)] sorted by place; shard: bytes
    that a kernel takes at once, at least; block: symbols of a route's text, about; heavy: anchor
    occurrences that a task takes of a route."""

    width: int
    ks: tuple[int, ...]
    hashes: Callable
    split: Callable
    join: Callable
    kernel: Callable
    shard: int
    block: int
    heavy: int


def _run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k symbols, by doubling: cheaper than gram_hashes and with more
    collisions on regular text, which cost a comparison in a kernel and no more."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out, width, cur, span, power = None, 0, h, 1, 0x9E3779B97F4A7C15
    while span <= k:
        by = np.uint64(power)
        if k & span:
            out = cur if out is None else out[: len(h) - width - span + 1] * by + cur[width : width + len(h) - width - span + 1]
            width += span
        if span * 2 <= k:
            cur = cur[: len(cur) - span] * by + cur[span:]
        span *= 2
        power = (power * power + 2 * span) % 2**64
    return scramble(out)


_PLACE = np.uint64((1 << 31) - 1)  # an Arrow string has fewer bytes


def window_anchors(h: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all runs of k, the anchor's position for each window start): the smallest
    by the upper bits of its number, the leftmost of equals."""
    g = _run_hashes(h, k)
    w = width - k + 1
    n = len(g) - w + 1
    if n <= 0:
        return g, np.empty(0, np.int64)
    low, span = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), 1
    while span * 2 <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    return g, (np.minimum(low[:n], low[w - span : w - span + n]) & _PLACE).astype(np.int64)


def occurrences(h: np.ndarray, ends: np.ndarray, width: int, k: int):
    """(anchor, row, first window, windows) of texts that lie one after another, of which no
    window reaches over an end."""
    g, at = window_anchors(h, width, k)
    if not len(at):
        return (np.empty(0, np.int64),) * 4
    owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    whole = owner[: len(at)] == owner[width - 1 : width - 1 + len(at)]
    fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1])])
    head = np.flatnonzero(fresh)
    n = np.diff(np.append(head, len(at)))
    head, n = head[whole[head]], n[whole[head]]
    row = owner[head]
    return signed(g[at[head]]), row, head - (ends - np.diff(ends, prepend=0))[row], n


def _anchors(pieces: DataFrame, kind: Kind, k: int) -> DataFrame:
    """pieces(doc_id, copy, base, raw) -> a row for each distinct anchor of each: n, how often, and
    at, where first."""

    def run(batches):
        for b in batches:
            doc, copy, base = (b.column(i).to_numpy() for i in range(3))
            for first, h, ends in kind.hashes(b.column(3)):
                anchor, row, at, _ = occurrences(h, ends, kind.width, k)
                order = np.lexsort((at, anchor, row))
                anchor, row, at = anchor[order], row[order], at[order]
                head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.empty(0, np.int64)
                n = np.diff(np.append(head, len(row)))
                row, at = row[head] + first, at[head]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[head]), pa.array(doc[row]), pa.array(copy[row]), pa.array(base[row]), pa.array((base[row] + at) // kind.block), pa.array(n)], ["anchor", "doc_id", "copy", "base", "block", "n"])

    return pieces.mapInArrow(run, "anchor long, doc_id long, copy int, base long, block long, n long")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_SEGMENTS = pa.schema([("route", pa.int64()), ("part", pa.int64()), ("more", pa.bool_()), ("doc_id", pa.int64()), ("copy", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("segment", pa.binary())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("raw", pa.binary())])


def _anywhere(doc: int, start: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{doc} {start}") >> 1


def _cut_segments(kind: Kind, k: int) -> Callable:
    """Per batch: (doc_id, copy, base, raw, anchors, routes, parts) -> segments; those equal to an
    earlier one of the batch come without bytes, as removed."""

    def segments(b: pa.RecordBatch):
        doc, copy, base = (b.column(i).to_pylist() for i in range(3))
        for first, h, ends in kind.hashes(b.column(3)):
            anchor, row, at, n = occurrences(h, ends, kind.width, k)
            edges = np.searchsorted(row, np.arange(len(ends) + 1)).tolist()
            for i, (x, y) in enumerate(zip(edges[:-1], edges[1:]), first):
                known, routes, parts = (b.column(c)[i].values.to_numpy() for c in (4, 5, 6))
                order = np.argsort(known)
                slot = np.searchsorted(known, anchor[x:y], sorter=order)
                slot = order[np.minimum(slot, len(known) - 1)]
                hit = np.flatnonzero(known[slot] == anchor[x:y])
                if not len(hit):
                    continue
                a, z, route, m = at[x:y][hit], (at + n)[x:y][hit], routes[slot[hit]], parts[slot[hit]]
                head = np.flatnonzero(np.concatenate([[True], (route[1:] != route[:-1]) | (a[1:] != z[:-1])]))
                last = np.append(head[1:], len(a)) - 1
                units, d, c, at0 = kind.split(b.column(3)[i].as_py()), doc[i], copy[i], base[i]
                for s, e, r, p in zip(a[head].tolist(), z[last].tolist(), route[head].tolist(), m[head].tolist()):
                    e += kind.width - 1
                    yield d, c, at0 + s, at0 + e, r, p, kind.join(units[s:e])

    def sent(b: pa.RecordBatch):
        first: dict[tuple, tuple] = {}
        for doc, copy, s, e, r, m, raw in segments(b):
            digest = xxhash.xxh3_128_intdigest(raw)
            here = (doc, s, copy, e, m, raw)
            old = first.setdefault((r, digest), here)
            if old is here or old[:2] == here[:2]:
                if old is not here:  # another row or text of the same place
                    yield r, digest % m, m > 1, doc, copy, s, e, raw
                continue
            if here[:2] < old[:2]:
                first[(r, digest)], here = here, old
            # needs no kernel, so it goes anywhere
            yield _anywhere(here[0], here[1]), 0, False, here[0], here[2], here[1], here[3], None
        for (r, digest), (doc, s, copy, e, m, raw) in first.items():
            yield r, digest % m, m > 1, doc, copy, s, e, raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 5000):
                yield from batches_of(sent(b.slice(i, 5000)), _SEGMENTS, 2000)

    return run


def joined(spans: list[tuple]) -> Iterator[tuple]:
    """(doc_id, copy, start, end) with those that touch or overlap as one."""
    last: list | None = None
    for doc, copy, a, z in sorted(spans):
        if last and (doc, copy) == (last[0], last[1]) and a <= last[3]:
            last[3] = max(last[3], z)
            continue
        if last:
            yield tuple(last)
        last = [doc, copy, a, z]
    if last:
        yield tuple(last)


def _shard(kind: Kind, held: list[tuple]) -> Iterator[tuple]:
    """Segments (doc_id, copy, start, bytes, more) -> _FOUND rows."""
    held.sort(key=lambda s: s[:3])
    ends, whole, later = kind.kernel([((s[0], s[1]), s[2], s[3]) for s in held])
    n, width = int(ends[-1]), kind.width
    hit = np.flatnonzero(later)
    cover = np.cumsum(np.bincount(hit, minlength=n + 1) - np.bincount(hit + width, minlength=n + 1)[: n + 1])[:n] > 0
    begin = ends - np.diff(ends, prepend=0)

    edge = np.zeros(n + 1, bool)
    edge[ends] = True

    def by_segment(mask):
        """(segment, start and end in it) of the runs in each segment."""
        first, last = mask.copy(), mask.copy()
        first[1:] &= ~mask[:-1] | edge[1:n]
        last[:-1] &= ~mask[1:] | edge[1:n]
        a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
        seg = np.searchsorted(ends, a, "right")
        return zip(seg.tolist(), (a - begin[seg]).tolist(), (z - begin[seg]).tolist())

    spans = []
    for s, a, z in by_segment(cover):
        doc, copy, start, *_ = held[s]
        spans.append((doc, copy, start + a, start + z))
    for doc, copy, a, z in joined(spans):
        yield doc, copy, a, z, None
    more = np.repeat(np.array([s[4] for s in held]), np.diff(ends, prepend=0))
    known, units = -1, None
    for s, a, z in by_segment(whole & ~later & more):
        doc, copy, start, raw, _ = held[s]
        if s != known:
            known, units = s, kind.split(raw)
        yield doc, copy, start + a, start + z - 1 + width, kind.join(units[a : z - 1 + width])


def _shards(kind: Kind) -> Callable:
    """Sorted segments -> found rows, a shard at a time; a route's part is never split."""

    def run(batches):
        def found():
            held, size, last = [], 0, None
            for b in batches:
                for i in range(0, b.num_rows, 500):
                    for route, part, more, doc, copy, start, end, raw in zip(*(c.to_pylist() for c in b.slice(i, 500).columns)):
                        if raw is None:
                            yield doc, copy, start, end, None
                            continue
                        if (route, part) != last and size >= kind.shard:
                            yield from _shard(kind, held)
                            held, size = [], 0
                        last = (route, part)
                        held.append((doc, copy, start, raw, more))
                        size += len(raw)
            if held:
                yield from _shard(kind, held)

        yield from batches_of(found(), _FOUND, 2000)

    return run


def _pass(pieces: DataFrame, kind: Kind, k: int, heavy: int) -> tuple[DataFrame, bool]:
    """One comparison of all windows of pieces(doc_id, copy, base, raw): the found rows, written, and
    whether windows may be left for another."""
    anchors = cut(_anchors(pieces, kind, k))
    # written, so that the join with a common anchor's many rows can be split
    again = cut(anchors.groupBy("anchor").agg(F.min("doc_id").alias("d"), F.min("block").alias("b"), F.sum("n").alias("c")).where("c > 1").select("anchor", F.xxhash64("d", "b").alias("route")))
    key = ["doc_id", "copy"] if k == kind.ks[0] else ["doc_id", "copy", "base"]  # whole documents first
    last = k == kind.width
    routed = cut(anchors.select("anchor", *key, "n").join(again, "anchor").select(*key, "anchor", "n", F.col("anchor" if last else "route").alias("route")))
    drop(anchors, again)
    size = cut(routed.groupBy("route").agg(F.ceil(F.sum("n") / heavy).alias("m")).where(F.lit(False) if last else F.col("m") > 1))
    several = not size.isEmpty()
    one = F.lit(1).cast("long")
    parted = routed.join(size, "route", "left").withColumn("m", F.coalesce("m", one)) if several else routed.withColumn("m", one)
    places = parted.groupBy(*key).agg(F.collect_list(F.struct("anchor", "route", "m")).alias("p"))
    cols = pieces.join(places.hint("merge"), key).select("doc_id", "copy", "base", "raw", *(F.col(f"p.{c}") for c in ("anchor", "route", "m")))
    segments = cols.mapInArrow(_cut_segments(kind, k), "route long, part long, more boolean, doc_id long, copy int, start long, end long, segment binary")
    found = segments.repartition("route", "part").sortWithinPartitions("route", "part").mapInArrow(_shards(kind), "doc_id long, copy int, start long, end long, raw binary")
    found = cut(found)
    drop(routed)
    return found, several


def removed_spans(docs: DataFrame, kind: Kind, heavy: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs(doc_id, copy, raw), spans(doc_id, copy, starts, ends))."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    several = cut(several.where("lo <> hi").select("doc_id", F.lit(True).alias("several")))
    # tells the texts of one doc_id apart, where there are several
    copy = F.when(F.col("several"), F.hash("text").bitwiseOR(1)).otherwise(0).alias("copy")
    docs = docs.join(several, "doc_id", "left").select("doc_id", copy, F.col("text").cast("binary").alias("raw"))
    pieces = docs.where("doc_id is not null").select("doc_id", "copy", F.lit(0).cast("long").alias("base"), "raw").where("raw is not null")
    heavy = heavy or kind.heavy
    found = []
    for k in kind.ks:
        rows_, several = _pass(pieces, kind, k, heavy)
        found.append(rows_)
        if not several:
            break
        pieces = rows_.where("raw is not null").select("doc_id", "copy", F.col("start").alias("base"), "raw")
    spans = None
    for f in found:
        f = f.where("raw is null").select("doc_id", "copy", "start", "end")
        spans = f if spans is None else spans.unionByName(f)
    return docs, spans.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "end")).alias("s")).select("doc_id", "copy", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))


def apply(docs: DataFrame, kind: Kind, finish: Callable, schema: str, heavy: int | None = None) -> DataFrame:
    """finish(units, removed mask) -> the result's columns after doc_id. heavy: instead of the kind's."""
    docs, spans = removed_spans(docs, kind, heavy)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    # spans grow with the documents: the same join at every size
    cols = docs.join(spans.hint("merge"), ["doc_id", "copy"], "left").select("doc_id", "raw", "starts", "ends")

    def run(batches):
        def made():
            for b in batches:
                for i in range(0, b.num_rows, 1000):
                    part = b.slice(i, 1000)
                    for d, raw, starts, ends in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)):
                        units = kind.split(raw or b"")
                        mask = np.zeros(len(units), bool)
                        if starts.is_valid:
                            edge = np.bincount(starts.values.to_numpy(), minlength=len(units) + 1) - np.bincount(ends.values.to_numpy(), minlength=len(units) + 1)
                            mask = np.cumsum(edge)[: len(units)] > 0
                        yield d, *finish(units, mask)

        yield from batches_of(made(), arrow, 2000)

    return cols.mapInArrow(run, schema)
