"""A graph of several parts is peeled part by part, with the rings of the whole graph."""

import numpy as np
import pytest

from ringloom.operators import cases, peel
from ringloom.plans import case_queries, ring_queries
from ringloom.sources import adapter

SF = "/root/testdata/sf0.001"


def _graph(seed, sizes, copies):
    """Edges, ids and scores of random parts, of which there are copies: equal contributions in several parts."""
    rng = np.random.default_rng(seed)
    edges, ids, score, at = [], [], [], 0
    for n in sizes:
        a, b = np.nonzero(np.triu(rng.random((n, n)) < 0.5, 1))
        w, s = rng.integers(1, 5, len(a)) / 4, rng.integers(0, 4, n) / 4
        for _ in range(copies):
            edges += zip((at + 3 * a).tolist(), (at + 3 * b).tolist(), w.tolist())
            ids += (at + 3 * np.arange(n)).tolist()
            score += s.tolist()
            at += 3 * n + 1
    used = np.unique([e[:2] for e in edges])
    ok = np.isin(ids, used)
    return edges, np.array(ids)[ok], np.array(score)[ok]


@pytest.mark.parametrize("seed,sizes,copies,k_min,k_max,top_k", [(1, (30, 29, 9, 6), 1, 3, 10, 9), (2, (20, 12), 3, 4, 8, 12), (3, (6, 6, 5, 4, 3), 2, 2, 12, 30), (4, (16, 15), 2, 5, 30, 6)])
def test_parts_have_the_rings_of_the_whole_graph(spark, monkeypatch, seed, sizes, copies, k_min, k_max, top_k):
    edges, ids, score = _graph(seed, sizes, copies)
    a, b = (np.searchsorted(ids, [e[i] for e in edges]).astype("int32") for i in (0, 1))
    order = np.lexsort((b, a))
    want = peel.top_rings(ids, a[order], b[order], np.array([e[2] for e in edges])[order], 2.0 * score, k_min, k_max, top_k)
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    s = spark.createDataFrame(list(zip(ids.tolist(), score.tolist())), "user_id long, score double")
    monkeypatch.setattr(peel, "_kernel", lambda *_: pytest.fail("the whole graph went to one task"))
    got = peel.extract_rings(e, s, lambda_=2.0, k_min=k_min, k_max=k_max, top_k=top_k, each=1).toPandas()
    assert got[["ring_id", "user_id"]].sort_values(["ring_id", "user_id"]).values.tolist() == want[["ring_id", "user_id"]].sort_values(["ring_id", "user_id"]).values.tolist()
    assert np.allclose(got.groupby("ring_id")["density"].first(), want.groupby("ring_id")["density"].first())


def test_connected_counts_ends(spark):
    e = spark.createDataFrame([(1, 2), (2, 5), (7, 9), (1, 5)], "src long, dst long")
    for most in (1, 100):
        got = peel.connected(e.repartition(3), most).orderBy("user_id").collect()
        assert [tuple(r) for r in got] == [(1, 1, 2), (2, 1, 2), (5, 1, 2), (7, 7, 1), (9, 7, 1)]


def test_the_queue_reads_orders_of_ring_members_only(spark, monkeypatch):
    rings = spark.createDataFrame([(1, 4, 2.0), (1, 7, 2.0)], "ring_id long, user_id long, density double")
    monkeypatch.setattr(ring_queries, "_peeled", lambda *_, **__: rings)
    queue = ring_queries._queue(spark, SF)
    assert queue._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
    o = adapter.orders(spark, SF).where("user_id in (4, 7)")
    assert [r.value_at_stake for r in queue.collect()] == [o.where("r6 is not null").count() * 100.0]


def test_the_sweep_gets_edges_of_live_accounts_only(spark, monkeypatch):
    got = []
    monkeypatch.setattr(cases, "sweep", lambda edges, *_: got.append(edges) or spark.range(1))
    case_queries.ring_sweep(spark, SF)
    live = adapter.accounts(spark, SF).where("score > 0.3").select("user_id")
    ends = got[0].selectExpr("explode(array(src, dst)) as user_id")
    assert ends.count() and ends.join(live, "user_id", "left_anti").isEmpty()


def test_both_halves_read_orders_joined_once(spark, monkeypatch):
    got = []
    monkeypatch.setattr(ring_queries, "_peeled", lambda s, d, half: got.append(half) or s.createDataFrame([(1, 1)], "ring_id long, user_id long"))
    ring_queries._halves(spark, SF)
    assert sum(o.count() for o in got) == adapter.orders(spark, SF).count()
    assert not any("l_orderkey" in o._jdf.queryExecution().optimizedPlan().toString() for o in got)
