import hashlib

import numpy as np
import pytest

from ringloom.llm import phrases, suffixes

from .helpers import corpus


def brute(texts, units, join, width):
    """{doc: (units, removed mask)} from all windows of all texts."""
    first = {}
    split = {d: units(t) for d, t in texts}
    for d in sorted(split):
        for i in range(len(split[d]) - width + 1):
            first.setdefault(tuple(split[d][i : i + width]), (d, i))
    out = {}
    for d, u in split.items():
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            if first[tuple(u[i : i + width])] < (d, i):
                gone[i : i + width] = [True] * width
        kept = join([x for x, g in zip(u, gone) if not g])
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("heavy", [None, 5, 1])
def test_phrases_equal_brute_force(frame, heavy):
    docs = corpus(1)
    want = brute([(d, t or "") for d, t in docs], lambda t: t.encode().split(), b" ".join, 20)
    from ringloom.llm import repeats

    got = {r.doc_id: r for r in repeats.apply(frame(docs), phrases.PHRASES, lambda w, g: phrases._finish(w, g)[:3], phrases._SCHEMA, heavy).collect()}
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in got.items()} == {d: (w[0], w[1], w[3]) for d, w in want.items()}
    assert sum(w[1] for w in want.values()) > 500


@pytest.mark.parametrize("heavy", [None, 5, 1])
def test_suffixes_equal_brute_force(frame, heavy):
    docs = corpus(2)
    want = brute([(d, t or "") for d, t in docs], lambda t: list(t.encode()), bytes, 100)
    from ringloom.llm import repeats

    got = {r.doc_id: r for r in repeats.apply(frame(docs), suffixes.SUFFIXES, lambda w, g: suffixes._finish(w, g)[:4], suffixes._SCHEMA, heavy).collect()}
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 1000


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for alphabet, n in ((2, 300), (4, 1000), (1, 50), (3, 1), (3, 7)):
        b = rng.integers(97, 97 + alphabet, n).astype(np.uint8)
        raw = b.tobytes()
        sa, _ = suffixes.suffix_array(b, n + 8)
        assert sa.tolist() == sorted(range(n), key=lambda i: raw[i:])
        lcp = suffixes.common_prefixes(b, sa)
        for x, y, m in zip(sa[:-1], sa[1:], lcp[1:]):
            assert raw[x : x + m] == raw[y : y + m] and raw[x + m : x + m + 1] != raw[y + m : y + m + 1]


def test_merge_of_parts_equals_one_array():
    segs = sorted(((d, 0), 0, t.encode()) for d, t in corpus(4)[:50] if t)
    ends, whole, later = suffixes.locate(segs, 30, most=10_000_000)
    assert later.sum() > 100
    for most in (1500, 400):
        parts = suffixes.locate(segs, 30, most=most)
        assert all((x == y).all() for x, y in zip((ends, whole, later), parts))


def test_automata_of_few_phrases_equal_one():
    segs = sorted(((d, 0), 0, b" ".join(t.encode().split())) for d, t in corpus(5) if t and t.split())
    one = phrases.locate(segs, 20)
    assert one[2].sum() > 100
    assert (phrases.locate(segs, 20, most=3)[2] == one[2]).all()


def test_many_distinct_words():
    text = b" ".join(b"%d" % i for i in range(70_000))
    ends, whole, later = phrases.locate([((1, 0), 0, text), ((2, 0), 0, text)], 20)
    assert ends.tolist() == [70_000, 140_000]
    assert not later[:70_000].any() and later.sum() == 70_000 - 19


def test_structured_words_have_different_hashes():
    from ringloom.llm.common import word_hashes

    turn = bytes(97 + bin(i).count("1") % 2 for i in range(4096))
    other = bytes(195 - c for c in turn)
    data = np.frombuffer(turn + b" " + other + b" ab ba AB", np.uint8)
    assert len(set(word_hashes(data, np.array([len(data)]), False)[0].tolist())) == 5
    assert len(set(word_hashes(data, np.array([len(data)]), True)[0].tolist())) == 4


def test_texts_of_one_id(spark):
    """Texts of one doc_id: compared with others, not with each other."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    df = spark.createDataFrame([(5, a), (5, b), (5, a), (9, b), (9, a + " x"), (2, None), (2, "z")], "doc_id long, text string")
    for f in (phrases.substring_dedup, suffixes.suffix_dedup):
        got = sorted((r[0], r[1], r.n_removed) for r in f(df).collect())
        n = 60 if f is phrases.substring_dedup else len(a)
        assert [g[2] for g in got if g[0] == 5] == [0, 0, 0]
        assert [g[2] for g in got if g[0] == 9] == [n, n]


def test_nulls_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    df = spark.createDataFrame([(1, long, "x", 9), (1, long, "y", 8), (None, long, "z", 7), (2, long, None, None), (3, None, None, None)], "doc_id long, text string, kept_sha256 string, n_removed int")
    for f, n in ((phrases.substring_dedup, 5000), (suffixes.suffix_dedup, len(long))):
        got = sorted((r[0] or -1, r.n_removed) for r in f(df).collect())
        assert got == [(-1, 0), (1, 0), (1, 0), (2, n), (3, 0)]
        assert f(df.where("doc_id > 9")).count() == 0
