"""Quality rules: an isolation forest over rule statistics.

Random splits on rule statistics isolate odd documents after few steps; the
mean path length over many trees is the anomaly score, and its threshold is
calibrated on labelled rows.

Trees are grown on labelled good rows only, each on `sample` of them, while the
ranges that splits are drawn from span all labelled rows. A statistic that is
constant over good rows can then still be split, which is what makes a value
outside their range isolate fast.

Nulls: a null text has no words, so it fails the base rules. A null doc_id
stays a row. Labels with nulls, or of documents that are not there, are
ignored; labels that contradict each other count as bad. Without both good and
bad labelled rows there is no threshold, and the base rules alone decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, rows, table, thrifty, words_of

SYMBOLS = "#*$%&|<>"
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punctuation_share", "distinct_share", "line_share")
#: Byte classes: 1 upper, 2 lower, 3 digit, 4 other printable ASCII.
_CLASS = np.array([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if 33 <= b <= 126 else 0 for b in range(256)], np.uint8)


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    if len(set(zip(words, words[1:], words[2:]))) == n:
        return 0
    count: dict[tuple, int] = {}
    for g in zip(words, words[1:], words[2:]):
        count[g] = count.get(g, 0) + 1
    hit, until = 0, 0
    for i, g in enumerate(zip(words, words[1:], words[2:])):
        if count[g] > 1:
            hit += i + 3 - max(i, until)
            until = i + 3
    return hit


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return dup


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] and the forest's features."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines, again = dup_lines(text), repeat_words(words)
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=5)
    per = 1 / max(n, 1)
    breaks = text.count("\n")
    feats = [np.log1p(n), chars * per, symbols * per, lines / (breaks + 1), again * per, kinds[1] / max(kinds[1] + kinds[2], 1), kinds[3] / max(chars, 1), kinds[4] / max(chars, 1), len(set(words)) * per, breaks * per]
    return [n, chars, symbols, lines, again], feats


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 50 or 100 * n_repeat > 50 * n_words


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n, with which a leaf of n rows counts."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split value, left child (right is the next), leaf depth."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    norm: float
    threshold: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1]; larger is odder."""
        total = np.zeros(len(x))
        at_row = np.arange(len(x))
        for f, v, l, d in zip(self.feature, self.value, self.left, self.depth):
            node = np.zeros(len(x), np.int64)
            while True:
                go = f[node] >= 0
                if not go.any():
                    break
                nxt = l[node] + (x[at_row, np.maximum(f[node], 0)] >= v[node])
                node = np.where(go, nxt, node)
            total += d[node]
        return np.exp2(-total / len(self.feature) / self.norm)


def grow(good: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
    """An isolation forest over good rows, with splits drawn from the box low..high."""
    rng = np.random.default_rng(seed)
    psi = min(sample, len(good))
    limit = int(np.ceil(np.log2(max(psi, 2)))) + 2
    grown = []
    for _ in range(trees):
        feature, value, left, depth = [-1], [0.0], [0], [0.0]
        stack = [(0, good[rng.choice(len(good), psi, replace=False)], low.copy(), high.copy(), 0)]
        while stack:
            at, x, lo, hi, d = stack.pop()
            open_ = np.flatnonzero(hi > lo)
            if len(x) <= 1 or d >= limit or not len(open_):
                depth[at] = d + float(expected_depth(len(x)))
                continue
            f = int(rng.choice(open_))
            v = float(rng.uniform(lo[f], hi[f]))
            feature[at], value[at], left[at] = f, v, len(feature)
            below, above = (lo, hi.copy()), (lo.copy(), hi)
            below[1][f], above[0][f] = v, v
            for rows_, (a, b) in ((x[x[:, f] < v], below), (x[x[:, f] >= v], above)):
                stack.append((len(feature), rows_, a, b, d + 1))
                feature.append(-1)
                value.append(0.0)
                left.append(0)
                depth.append(0.0)
        grown.append((feature, value, left, depth))
    width = max(len(t[0]) for t in grown)
    pad = lambda k, kind: np.array([t[k] + [-1 if k == 0 else 0] * (width - len(t[k])) for t in grown], kind)
    return Forest(pad(0, np.int64), pad(1, float), pad(2, np.int64), pad(3, float), float(expected_depth(psi)) or 1.0)


def calibrate(forest: Forest, good: np.ndarray, bad: np.ndarray, false_weight: float = 10.0) -> float | None:
    """The threshold of least cost on labelled rows, one rejected good row costing as
    much as false_weight kept bad ones; None without rows of both kinds."""
    if not len(good) or not len(bad):
        return None
    g, b = np.sort(forest.score(good)), np.sort(forest.score(bad))
    at = np.unique(np.concatenate([g, b]))
    cuts = np.concatenate([(at[1:] + at[:-1]) / 2, at[-1:] + 1e-6])
    cost = false_weight * (len(g) - np.searchsorted(g, cuts, "right")) + np.searchsorted(b, cuts, "right")
    return float(cuts[np.argmin(cost)])


_STATS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, feats array<double>"


def rule_statistics(docs: DataFrame) -> DataFrame:
    """Rule statistics and features of every whole text."""

    @thrifty
    def run(batches):
        for ids, texts in rows(batches, "doc_id", "text"):
            made = [statistics(t) for t in texts]
            cols = list(zip(*(m[0] for m in made)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in cols), pa.array([m[1] for m in made], pa.list_(pa.float64()))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "feats"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _STATS)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> Forest | None:
    """Fit on the max_labelled labelled rows of smallest md5(doc_id) at most: trees on one
    half of the good ones, the threshold on the other half and all bad ones. Rows that
    fail the base rules are left out, as the forest never judges them."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    marks = marks.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled)
    some = docs.select("doc_id", "text").join(F.broadcast(marks.select("doc_id")), "doc_id", "left_semi")
    found = rule_statistics(some).join(F.broadcast(marks), "doc_id").select("doc_id", "n_words", "n_repeat_words", "feats", "quality").collect()
    found = sorted({(r.doc_id, r.quality, tuple(r.feats)) for r in found if not base_failed(r.n_words, r.n_repeat_words)})
    x, good = np.array([r[2] for r in found], float).reshape(-1, len(FEATURES)), np.array([r[1] >= 1 for r in found], bool)
    if good.sum() < 8 or not (~good).any():
        return None
    place = np.cumsum(good) % 2
    low, high = x.min(0), x.max(0)
    forest = grow(x[good & (place == 0)], low, high)
    forest.threshold = calibrate(forest, x[good & (place == 1)], x[~good])
    return forest


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, anomaly (null where base rules decide or there is no
    forest). One row per input row; other columns of docs are not looked at."""
    forest = fit(docs, labels, max_labelled)

    def judge(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n, again = b.column("n_words").to_numpy(), b.column("n_repeat_words").to_numpy()
            failed = (n < 50) | (100 * again > 50 * n)
            score = np.zeros(len(n))
            if forest is not None and (~failed).any():
                x = np.array(b.column("feats").to_pylist(), float)[~failed]
                score[~failed] = forest.score(x)
            kept = ~failed & (True if forest is None else score < forest.threshold)
            cols = [b.column(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(kept), pa.array(score, mask=failed | (forest is None))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"])

    return rule_statistics(docs).mapInArrow(judge, _STATS.replace("feats array<double>", "base_failed boolean, kept boolean, anomaly double"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, without a shuffle.
    Only the first column named text is looked at."""
    forest = fit(docs, labels, max_labelled)

    @thrifty
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                made = [statistics(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                kept = np.array([not base_failed(m[0][0], m[0][4]) for m in made])
                if forest is not None and kept.any():
                    kept[kept] = forest.score(np.array([m[1] for m, k in zip(made, kept) if k], float)) < forest.threshold
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
