"""What keeps op5, op9 and the pipeline within their memory."""

import random

import numpy as np
from pyspark.sql import functions as F

from ringloom.llm import common, jaccard, pieces, quality

from .helpers import corpus

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_jaccard_runs_with_small_arrow_batches(spark, frame, monkeypatch):
    seen, cut = [], jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df: seen.append(int(spark.conf.get(ROWS))) or cut(df))
    before = spark.conf.get(ROWS)
    jaccard.jaccard_components(frame(corpus(2)), 3, 90).count()
    assert seen and max(seen) <= 1000 and spark.conf.get(ROWS) == before


def test_fronts_are_the_first_tokens_of_one_order(spark):
    rng = random.Random(1)
    df = {rng.randrange(-(2**63), 2**63): rng.randint(2, 4) for _ in range(40)}
    rows = [(i, rng.randint(1, 8), [(df[t], t) for t in rng.sample(list(df), rng.randint(8, 20))]) for i in range(30)]
    lists = spark.createDataFrame(rows, "doc_id long, length long, shared array<struct<df: long, token: long>>")
    got = {r.doc_id: (r.p0, r.p1) for r in jaccard._fronts(lists).collect()}
    for seed, j in zip(jaccard._SEEDS, (0, 1)):
        key = lambda t: (df[t], int(common.scramble(np.array([t]).view(np.uint64) ^ seed)[0]))
        assert all(got[i][j] == sorted((t for _, t in shared), key=key)[:k] for i, k, shared in rows)
    assert any(a != b for a, b in got.values())
    assert jaccard._fronts(lists.where(F.lit(False))).count() == 0


def test_pieces_remember_a_bounded_number_of_stretches():
    import sentencepiece

    path = pieces.model_path()
    mine, theirs = pieces.Pieces(path, 50), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh é漢́") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in (" ".join(words), "  ".join(words), "\n".join(words), "".join(words), words[0], "a" * 9000, " ".join(f"{w}.,{w}$$$" for w in words), "x." * 300 + " x.\n x. é."):
        assert mine.encode(text).tolist() == theirs.encode(text)
        for memory in (mine.known, mine.bare):
            assert len(memory) + len(memory.before) <= 100
        assert len(mine.pairs) <= 100
    made = []
    memory = pieces.Memory(lambda k: (made.append(k) or k, k != "x"), 2)
    assert [memory[k] for k in "abxcxabca"] == list("abxcxabca") and made == list("abxcx")


def test_functions_give_free_memory_back(monkeypatch):
    freed = []
    monkeypatch.setattr(common, "free_memory", lambda: freed.append(1))
    run = common.thrifty(lambda batches: (b + 1 for b in batches))
    assert list(run([1, 2])) == [2, 3] and freed == [1]
    some = run([1, 2])
    assert next(some) == 2
    some.close()
    assert freed == [1, 1]


def test_quality_keeps_the_same_rows_of_batches_in_parts(spark, frame):
    texts = [f"{'word ' * 70 if i % 3 else ''}" + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(2500)]
    docs, labels = frame(list(enumerate(texts))).coalesce(1), spark.createDataFrame([], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.quality_rules(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == kept and 0 < len(kept) < 2500
