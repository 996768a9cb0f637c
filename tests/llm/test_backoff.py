import math
from collections import Counter

import pytest

from ringloom.llm import backoff

from .helpers import corpus


def brute(docs, order):
    """(doc_id, words, score) by plain counting."""
    split = [(d, [w for w in (t or "").lower().encode().split()]) for d, t in docs]
    count = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    whole = Counter()
    for _, w in split:
        whole.update(count(w))
    n = sum(len(w) for _, w in split)
    out = []
    for d, w in split:
        own, total = count(w), 0.0
        c = lambda g: whole[g] - own[g]  # noqa: B023, E731

        def score(words):
            if len(words) == 1:
                return (c(words) or 0.5) / max(n - len(w), 1)  # noqa: B023
            return c(words) / c(words[:-1]) if c(words) else 0.4 * score(words[1:])

        for i in range(len(w)):
            total += math.log(score(tuple(w[max(0, i - order + 1) : i + 1])))
        out.append((d, len(w), total))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(frame, order):
    docs = [(d, t and t.replace("é", "e")) for d, t in corpus(5)] + [(None, "a b a b zz"), (7, "a b"), (7, "a b")]
    want = sorted(brute(docs, order), key=str)
    for block in (1_000_000, 200):
        got = sorted(((r.doc_id, r.n_words, r.log_score) for r in backoff.stupid_backoff(frame(docs), order, block).collect()), key=str)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))


def test_empty(frame):
    assert backoff.stupid_backoff(frame([])).count() == 0
    assert [tuple(r) for r in backoff.stupid_backoff(frame([(1, None), (2, "")])).collect()] == [(1, 0, 0.0, None), (2, 0, 0.0, None)]
