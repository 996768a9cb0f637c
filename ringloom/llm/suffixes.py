"""Suffix-array dedup of bytes.

repeats.py brings the places together where 100-byte windows can recur, by
hashes of their anchors. Here a task's segments are taken in shards of `most`
bytes. A shard's suffix array is built by Larsson-Sadakane refinement (ranks of 8 bytes,
then doubled, only groups that are not resolved yet being sorted again, until windows are
told apart), Kasai's common prefixes of neighbours are computed (positions that
follow from the one before are filled in, the rest compared), and runs of
neighbours with 100 bytes or more in common are the equal windows. Shards are merged by
binary search of the distinct windows of one in the sorted ones of another, and
the least place of each window wins. What is first in its task meets the other tasks'
in the next pass.

One row per input row. Nulls, ties, repeated rows and very long texts: see
repeats.py. A null or empty text gives zero bytes and the hash of nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .common import scramble, slices, table

WIDTH = 100
_CODE = scramble(np.arange(1, 257, dtype=np.uint64))


def _hashes(column):
    """Slices of a column: a number for each byte, and where each row's bytes end."""
    for row, data, ends in slices(column, 40_000):
        yield row, _CODE[data], ends


def _eights(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as numbers, each byte plus one (UTF-8 has no 255),
    so that only what is past the end is zero."""
    x = np.concatenate([b + np.uint8(1), np.zeros(8, np.uint8)]).astype(np.uint64)
    out = x
    for s in (1, 2, 4):
        out = (out[:-s] << np.uint64(8 * s)) | out[s:]
    return out[: len(b)]


def suffix_array(b: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `depth` bytes, rank of each: equal while not told apart).

    With depth >= len(b) this is the full suffix array."""
    n = len(b)
    key = _eights(b)
    sa = np.argsort(key)
    ordered = key[sa]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    group = np.flatnonzero(new)
    rank[sa] = np.repeat(group, np.diff(np.append(group, n)))
    h = 8
    while h < depth:
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, n))
        open_ = np.repeat(sizes > 1, sizes)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        mine = sa[at]
        far = mine + h
        second = np.where(far < n, rank[np.minimum(far, n - 1)], -1)
        order = np.argsort(rank[mine] * (n + 1) + second + 1)
        sa[at] = mine[order]
        first, second = rank[mine][order], second[order]
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        new[at] = fresh
        place = at[fresh]
        rank[sa[at]] = np.repeat(place, np.diff(np.append(np.flatnonzero(fresh), len(at))))
        h *= 2
    return sa, rank


def common_prefixes(b: np.ndarray, sa: np.ndarray, width: int | None = None) -> np.ndarray:
    """Bytes that each suffix in order has in common with the one before it (first: 0). With
    width, counts beyond it may come out lower, but not below it: comparisons end
    after 4 widths then, and positions further on are compared anew."""
    n = len(b)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    # Kasai: if the position before and its neighbour agree in a byte and are both one back, what
    # they have in common is one byte more than here
    prev = before[:-1]
    follows = np.concatenate([[False], (prev >= 0) & (before[1:] == prev + 1) & (b[:-1] == b[np.maximum(prev, 0)])])
    pos = np.arange(n)
    most = n
    if width is not None:
        most = 4 * width + 16
        chain = pos - np.maximum.accumulate(np.where(follows, 0, pos))
        follows &= chain % (3 * width) != 0
    eights = _eights(b)
    todo = np.flatnonzero(~follows & (before >= 0))
    other = before[todo]
    got = np.zeros(len(todo), np.int64)
    active = np.arange(len(todo))
    while len(active):
        x, y = todo[active] + got[active], other[active] + got[active]
        same = (n - np.maximum(x, y) >= 8) & (eights[np.minimum(x, n - 1)] == eights[np.minimum(y, n - 1)])
        active = active[same]
        got[active] += 8
        if len(active) and got[active[0]] >= most:
            break
    active = np.flatnonzero(got < most)
    while len(active):
        x, y = todo[active] + got[active], other[active] + got[active]
        active = active[(np.maximum(x, y) < n) & (b[np.minimum(x, n - 1)] == b[np.minimum(y, n - 1)])]
        got[active] += 1
    length = np.zeros(n, np.int64)
    length[todo] = got
    root = np.maximum.accumulate(np.where(follows, 0, pos))
    return (length[root] - (pos - root))[sa]


def _classes(b: np.ndarray, valid: np.ndarray, loc: np.ndarray, width: int):
    """(window starts by class, class heads, the first place of each class) of valid starts."""
    sa, _ = suffix_array(b, width)
    lcp = common_prefixes(b, sa, width)
    new = lcp < width
    group = np.cumsum(new) - 1
    keep = valid[sa]
    starts, group = sa[keep], group[keep]
    if not len(starts):
        return starts, np.empty(0, np.int64), np.empty(0, np.int64)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return starts, heads, np.minimum.reduceat(loc[starts], heads)


def locate(segments: list[tuple[tuple, int, bytes]], width: int = WIDTH, most: int = 400_000):
    """(ends, whole, later) for Kind.kernel. segments: (document, start, bytes), sorted by
    place. most: bytes of a shard, which are cut between segments."""
    size = np.array([len(s[2]) for s in segments])
    ends = np.cumsum(size)
    begin = np.concatenate([[0], ends])
    b = np.frombuffer(b"".join(s[2] for s in segments), np.uint8)
    at = np.arange(len(b)) - np.repeat(begin[:-1], size)
    whole = at <= np.repeat(size, size) - width
    # rows of one doc_id are at the same place, none before another
    ids = np.unique(np.array([s[0][0] for s in segments]), return_inverse=True)[1]
    place = (np.repeat(ids, size) << 40) + np.repeat(np.array([s[1] for s in segments]), size) + at
    first = place.copy()
    cuts = np.unique(np.searchsorted(begin, np.arange(0, len(b), most))).tolist() + [len(segments)]
    lists = []
    for p, q in zip(cuts[:-1], cuts[1:]):
        if p == q:
            continue
        lo, hi = int(begin[p]), int(begin[q])
        s, heads, low = _classes(b[lo:hi], whole[lo:hi], place[lo:hi], width)
        if len(s):
            first[lo + s] = np.repeat(low, np.diff(np.append(heads, len(s))))
            lists.append((lo + s, heads, low))
    if len(lists) > 1:
        _merge(b, lists, first, width)
    return ends, whole, whole & (first < place)


def _merge(b: np.ndarray, lists: list, first: np.ndarray, width: int) -> None:
    """Binary search of each part's distinct windows in the others'; the least place wins."""
    view = np.lib.stride_tricks.sliding_window_view(b, width)
    kind = f"S{width + 1}"

    def keys(starts):
        # a trailing mark, as numpy's byte strings drop zeros at their end
        out = np.empty((len(starts), width + 1), np.uint8)
        out[:, :width] = view[starts]
        out[:, width] = 1
        return out.view(kind).ravel()

    sorted_ = [keys(s[heads]) for s, heads, _ in lists]
    lows = [low.copy() for _, _, low in lists]
    for i in range(len(lists)):
        for j in range(i):
            at = np.searchsorted(sorted_[j], sorted_[i])
            ok = at < len(sorted_[j])
            ok[ok] = sorted_[j][at[ok]] == sorted_[i][ok]
            mine, other = np.flatnonzero(ok), at[ok]
            low = np.minimum(lists[i][2][mine], lists[j][2][other])
            lows[i][mine] = np.minimum(lows[i][mine], low)
            lows[j][other] = np.minimum(lows[j][other], low)
    for (s, heads, _), low in zip(lists, lows):
        first[s] = np.repeat(low, np.diff(np.append(heads, len(s))))


SUFFIXES = repeats.Kind(width=WIDTH, ks=(32, 72, WIDTH), hashes=_hashes, split=bytes, join=bytes, kernel=locate, shard=150_000, block=1024, heavy=30_000)


def _finish(raw: bytes, gone: np.ndarray):
    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if gone.any() else raw
    return len(raw), len(raw) - len(kept), len(repeats._runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept


_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, contents: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with
    contents, kept: the remaining bytes (binary, as a cut may fall inside a character)."""
    if not contents:
        return repeats.apply(docs, SUFFIXES, lambda raw, gone: _finish(raw, gone)[:4], _SCHEMA)
    return repeats.apply(docs, SUFFIXES, _finish, _SCHEMA + ", kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), contents=False)
