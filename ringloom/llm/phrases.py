"""Substring dedup by repeated-phrase automata.

repeats.py brings the places together where 20-word windows can recur. Here a
shard of segments is taken at once: passages that recur are confirmed, Aho-Corasick
automata are compiled from the first occurrences of the confirmed ones, `most` of them
each, and all segments stream through every automaton, which locates
every occurrence. Each automaton numbers the words of its own phrases, 20 * most at most,
and a word becomes the three digits of its number to base 64, each with characters of its
own: a shard may hold any number of words, no node has more than 64 children, and a
match begins where a word does.

One row per input row. Nulls, ties, repeated rows and very long texts: see
repeats.py. A null or empty text gives zero words and the hash of nothing.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .common import gram_hashes, scramble, slices, table, word_hashes

WIDTH = 20
#: Phrases of one automaton; their words have numbers of three digits to base 64.
MOST = 13_000


def _hashes(column):
    """Slices of a column: word hashes, and where each row's words end."""
    for row, data, ends in slices(column, 64_000):
        yield row, *word_hashes(data, ends, False)


def confirmed(code: np.ndarray, whole: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Of the whole windows that recur, the first places, in order of place."""
    at = np.flatnonzero(whole)
    if not len(at):
        return at
    h = gram_hashes(scramble(code.astype(np.uint64) + np.uint64(1)), width)[at]
    order = np.lexsort((place[at], h))
    new = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
    return np.sort(at[order][new[np.diff(np.append(new, len(order))) > 1]])


def locate(segments: list[tuple[tuple, int, bytes]], width: int = WIDTH, most: int = MOST):
    """(ends, whole, later) for Kind.kernel. segments: (document, start, words joined by a
    space), sorted by place."""
    number: dict[bytes, int] = {}
    codes: list[int] = []
    ends = np.empty(len(segments), np.int64)
    for i, (_, _, raw) in enumerate(segments):
        codes += [number.setdefault(w, len(number)) for w in raw.split(b" ")]
        ends[i] = len(codes)
    code = np.array(codes, np.int64)
    size = np.diff(ends, prepend=0)
    begin = ends - size
    at = np.arange(len(code)) - np.repeat(begin, size)
    whole = at <= np.repeat(size, size) - width
    # rows of one doc_id are at the same place, none before another
    ids = np.unique(np.array([s[0][0] for s in segments]), return_inverse=True)[1]
    place = (np.repeat(ids, size) << 40) + np.repeat(np.array([s[1] for s in segments]), size) + at
    later = np.zeros(len(code), bool)
    firsts = confirmed(code, whole, place, width)
    for i in range(0, len(firsts), most):
        phrases = firsts[i : i + most]
        own = np.unique(code[(phrases[:, None] + np.arange(width)).ravel()])
        symbol = np.zeros(len(number), np.int64)  # 0 is a word of no phrase
        symbol[own] = np.arange(1, len(own) + 1)
        digits = symbol[code][:, None] // np.array([4096, 64, 1]) % 64 + np.array([1, 65, 129])
        text = digits.astype(np.uint8).tobytes().decode("latin-1")
        automaton = ahocorasick.Automaton()
        for p in phrases.tolist():
            automaton.add_word(text[3 * p : 3 * (p + width)], p)
        automaton.make_automaton()
        for a, z in zip(begin.tolist(), ends.tolist()):
            found = list(automaton.iter(text[3 * a : 3 * z]))
            if found:
                where = np.array([f[0] for f in found]) // 3 + (a - width + 1)
                first = np.array([f[1] for f in found])
                later[where] = place[where] > place[first]
    return ends, whole, later


PHRASES = repeats.Kind(width=WIDTH, ks=(5, 12, WIDTH), hashes=_hashes, split=bytes.split, join=b" ".join, kernel=locate, shard=400_000, block=256, heavy=100_000)


def _finish(words: list[bytes], gone: np.ndarray):
    kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
    text = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text


_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def substring_dedup(docs: DataFrame, texts: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256 and, with texts, kept:
    the kept words joined by spaces."""
    if not texts:
        return repeats.apply(docs, PHRASES, lambda words, gone: _finish(words, gone)[:3], _SCHEMA)
    return repeats.apply(docs, PHRASES, lambda words, gone: (lambda r: (*r[:3], r[3].decode("utf-8", "replace")))(_finish(words, gone)), _SCHEMA + ", kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), texts=False)
