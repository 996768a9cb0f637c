import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ringloom.operators import cards, graph, iterate, metrics, peel, policy, rings, stress
from ringloom.plans import registry
from ringloom.sources import readers
from ringloom.streaming.nightly import Tracker

SF = "/root/testdata/sf0.001"


# kernels


def density(members, edges, scores, lam):
    m = set(members)
    return (sum(w for a, b, w in edges if a in m and b in m) + lam * sum(scores[v] for v in m)) / len(m)


def clique(nodes, w):
    return [(a, b, w) for a, b in itertools.combinations(sorted(nodes), 2)]


def test_planted_rings_are_recovered(spark):
    rng = random.Random(20260902)
    planted = [range(0, 40), range(100, 120), range(200, 208)]
    edges = {(min(a, b), max(a, b)): 0.1 for a, b in ((rng.randrange(1500), rng.randrange(1500)) for _ in range(3000)) if a != b}
    for p in planted:
        edges |= {(a, b): 0.95 for a, b, _ in clique(p, 0.95)}
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    s = spark.createDataFrame([(v, 0.0) for v in range(1500)], "user_id long, score double")
    for small in (200_000, 10):
        got = peel.extract_rings(e, s, lambda_=0.0, k_min=5, k_max=500, top_k=3, small=small).toPandas()
        for i, p in enumerate(planted, 1):
            found = set(got[got.ring_id == i].user_id)
            assert len(found & set(p)) / len(found | set(p)) >= 0.9


def blob_graph():
    """1,200 even vertices, less even ones inside, so that no contribution is far above the mean."""
    rng = random.Random(5)
    draws = [(rng.randrange(1200), rng.randrange(1200)) for _ in range(14000)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(300)]
    return {(min(a, b), max(a, b)): round(0.9 + rng.random() / 1000, 6) for a, b in draws if a != b}, {v: 0.0 for v in range(1200)}


def hub_graph():
    """Three hubs with 500 leaves each, a clique of 12, a short chain, and high scores on some leaves."""
    rng = random.Random(6)
    edges = {(h, 100 + 500 * h + i): round(0.3 + rng.random() / 10, 6) for h in range(3) for i in range(500)}
    edges |= {(a, b): round(0.8 + rng.random() / 10, 6) for a, b, _ in clique(range(50, 62), 0)} | {(2000 + i, 2001 + i): 0.5 for i in range(6)} | {(2, 50): 0.4}
    return edges, {v: round(rng.random() * 0.3, 6) if v % 7 else round(0.9 + rng.random() / 20, 6) for p in edges for v in p}


@pytest.mark.parametrize("made,lam,k_max", [(blob_graph, 0.0, 500), (hub_graph, 1.0, 40)])
def test_rings_do_not_depend_on_the_size_switch(spark, made, lam, k_max):
    edges, scores = made()
    e = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    s = spark.createDataFrame(list(scores.items()), "user_id long, score double")
    whole, cored = (peel.extract_rings(e, s, lambda_=lam, k_min=5, k_max=k_max, top_k=2, small=small).toPandas() for small in (200_000, 0))
    assert len(whole) >= 5
    for i in (1, 2):
        a, b = whole[whole.ring_id == i], cored[cored.ring_id == i]
        assert set(a.user_id) == set(b.user_id) and a.density.max() == pytest.approx(b.density.max())


@pytest.mark.parametrize("made,lam,k_max", [(blob_graph, 0.0, 500), (hub_graph, 1.0, 40)])
def test_a_kernel_that_cuts_cores_finds_the_rings_of_the_whole_graph(made, lam, k_max):
    edges, scores = made()
    ids = np.array(sorted(scores))
    a, b = (np.searchsorted(ids, [p[i] for p in sorted(edges)]) for i in (0, 1))
    w, mass = np.array([edges[p] for p in sorted(edges)]), lam * np.array([scores[v] for v in ids])
    whole, cored = (peel.top_rings(ids, a, b, w, mass, 5, k_max, 4, few=few).reset_index(drop=True) for few in (200_000, 0))
    pd.testing.assert_frame_equal(whole, cored)
    assert whole.ring_id.max() >= 2


@pytest.mark.parametrize("pinned", [None, 3])
def test_peel_order_is_that_of_the_least_contribution(pinned):
    edges, scores = hub_graph()
    n = max(scores) + 1
    gain, near, left = {v: scores.get(v, 0.0) for v in range(n)}, {v: [] for v in range(n)}, n
    for (a, b), w in edges.items():
        near[a].append((b, w))
        near[b].append((a, w))
        gain[a] += w
        gain[b] += w
    want = []
    while left > 1:
        v = min((v for v in gain if v != pinned), key=lambda v: (gain[v], v))
        want.append(v)
        left -= 1
        del gain[v]
        for u, w in near[v]:
            if u in gain:
                gain[u] -= w
    ends = np.array(list(edges))
    order, values = peel.peel_order(n, ends[:, 0], ends[:, 1], np.array(list(edges.values())), np.array([scores.get(v, 0.0) for v in range(n)]), pinned)
    assert order == want and len(values) == n


def test_exact_peel_density_is_that_of_its_set():
    rng = np.random.default_rng(1)
    n = 30
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.2]
    w, s = rng.random(len(pairs)), rng.random(n)
    order, values = peel.peel_order(n, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), w, 2 * s)
    found, g = peel.best_set(n, order, values, 3, None)
    assert g == pytest.approx(density(found, [(a, b, x) for (a, b), x in zip(pairs, w)], s, 2))
    assert peel.best_set(n, order, values, 3, 10)[0].size <= 10


def test_anchored_rings_of_two_cliques(spark):
    edges = clique(range(8), 1.0) + clique(range(8, 16), 1.0) + [(0, 8, 0.05)] + [(0, v, 5.0) for v in range(30, 34)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    s = spark.createDataFrame([(v, 0.9 if v < 16 else 0.0) for v in range(40)], "user_id long, score double")
    ref = s.where("score > 0.5")
    anchors = spark.createDataFrame([(3,), (12,), (4,)], "anchor long")
    balls = graph.ball(e, anchors, ref.select("user_id"))
    assert balls.where("user_id >= 30").count() == 0
    got = peel.anchored_rings(e, s, balls, lambda_=0.0).toPandas()
    assert set(got[got.anchor == 3].user_id) == set(range(8)) == set(got[got.anchor == 4].user_id)
    assert set(got[got.anchor == 12].user_id) == set(range(8, 16))
    kept = peel.dedupe(spark.createDataFrame(got.rename(columns={"anchor": "ring_id"})), [F.max("density").alias("d")], 0.5)
    assert {r.ring_id for r in kept.select("ring_id").distinct().collect()} == {3, 12}


@pytest.mark.parametrize("seed", range(12))
def test_knapsack_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(0, 11))
    v, w, c = rng.random(n) * 10 - 1, rng.integers(1, 15, n), int(rng.integers(0, 40))
    best = max(sum(v[list(s)]) if s else 0.0 for k in range(n + 1) for s in itertools.combinations(range(n), k) if sum(w[list(s)]) <= c) if n else 0.0
    got = policy.knapsack(v, w, c)
    assert sum(w[got]) <= c and sum(v[got]) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(3))
def test_plans_and_outcomes_equal_brute_force(spark, seed):
    """A night of seven rings: the plan is the best of all choices, and the money is added up by hand."""
    rng = random.Random(seed)
    rows = [(1, i, rng.random(), rng.uniform(100, 5000), rng.uniform(100, 20000), rng.randint(3, 40), rng.random() * 9, rng.uniform(0, 4000), rng.uniform(0, 9000)) for i in range(7)]
    eco = spark.createDataFrame(rows, "night long, ring_id long, p double, value_at_stake double, legitimate_exposed double, review_minutes long, density double, realised_stake double, realised_harm double")
    eco = policy.expected_values(eco, 0.1)
    plans = policy.plan(eco, (60,)).toPandas()
    hold = {r[1]: r[2] * r[3] - (1 - r[2]) * r[4] * 0.1 for r in rows}
    gain = {r[1]: max(0.0, r[2] * r[3] - max(hold[r[1]], 0)) for r in rows}
    minutes = {r[1]: r[5] for r in rows}
    picked = lambda p, a: set(plans[(plans.policy == p) & (plans.action == a)].ring_id)
    best = max(sum(gain[i] for i in s) for k in range(8) for s in itertools.combinations(range(7), k) if sum(minutes[i] for i in s) <= 60)
    first = picked("capacity", "review")
    assert sum(gain[i] for i in first) == pytest.approx(best) and sum(minutes[i] for i in first) <= 60
    assert picked("capacity", "hold") == {i for i in range(7) if hold[i] > 0} - first and picked("hold_all", "hold") == set(range(7))
    dense, left = set(), 60
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if r[5] <= left:
            dense.add(r[1])
            left -= r[5]
    assert picked("density", "review") == dense and not picked("density", "hold")
    got = policy.outcomes(spark.createDataFrame(plans), eco, 0.1, 0.9, (60,)).toPandas().set_index("policy")
    total = sum(r[7] for r in rows)
    for name in policy.POLICIES:
        rev, held = picked(name, "review"), picked(name, "hold")
        stopped = sum(r[7] * (0.9 if r[1] in rev else 1.0) for r in rows if r[1] in rev | held)
        harmed = sum(r[8] * 0.1 * (0.1 if r[1] in rev else 1.0) for r in rows if r[1] in rev | held)
        cost = 10 * sum(minutes[i] for i in rev)
        assert got.loc[name, ["stopped", "harmed", "analyst_cost"]].tolist() == pytest.approx([stopped, harmed, cost])
        assert got.loc[name, "savings"] == pytest.approx(1 - (total - stopped + harmed + cost) / total)
    said = {r.ring_id: r.decision for r in policy.decide(eco, (60,)).collect()}
    assert said == {i: "review" if i in first else "hold" if hold[i] > 0 else "ignore" for i in range(7)}


def test_ring_features_of_a_chain(spark):
    """Thirty members in a chain that share entities of four, by two relations, three days each."""
    m = spark.createDataFrame([(1, v) for v in range(30)], "ring_id long, user_id long")
    e = spark.createDataFrame([(v, v + 1, 0.5, 5, 4) for v in range(29)], "src long, dst long, weight float, relation_mask int, min_entity_size long")
    s = spark.createDataFrame([(v, v / 30) for v in range(30)], "user_id long, score double")
    o = spark.createDataFrame([(v, d, 1 if d == 2 else None) for v in range(30) for d in range(3)], "user_id long, day_ordinal long, r6 long")
    r = rings.ring_features(m, e, s, o, 0.5, 2.0).first()
    assert tuple(r.asDict()) == ("ring_id", *rings.RING_FEATURES) and len(rings.RING_FEATURES) == 21
    mass = sum(v / 30 for v in range(30))
    want = dict(size=30, density=(14.5 + 2 * mass) / 30, relation_kinds=2, top_entity_coverage=29 / 435, top_entity_platform_count=4, top_entity_rarity=1 / np.log(6), rare_edge_share=1, score_median=14.5 / 30, orders_per_member=3, promo_share=1 / 3, busiest_day_share=1 / 3, day_span=3, active_days_per_member=0.1)
    for k, v in want.items():
        assert r[k] == pytest.approx(v), k
    assert r["lambda"] == 2.0 and r.score_std == pytest.approx(np.std([v / 30 for v in range(30)])) and r.score_p10 == pytest.approx(np.percentile([v / 30 for v in range(30)], 10))


def test_blend_of_score_and_context(spark):
    got = rings.blend(spark.createDataFrame([(1, 0.9, 0.0), (2, 0.5, 4.0), (3, 0.1, 4.0)], "user_id long, score double, context double")).orderBy("user_id").collect()
    assert [r.boosted for r in got] == pytest.approx([0.9, 1.0, 0.2]) and [r.tie_break for r in got] == pytest.approx([0.9, 0.500001, 0.100001], abs=1e-12)
    with pytest.raises(ValueError):
        rings.assert_horizon((1, 5), (5, 8))
    assert rings.assert_horizon((1, 4), (5, 8)) == 1


def test_small_balls_have_no_ring(spark):
    e = spark.createDataFrame(clique(range(4), 1.0), "src long, dst long, weight double")
    s = spark.createDataFrame([(v, 0.9) for v in range(4)], "user_id long, score double")
    balls = graph.ball(e, spark.createDataFrame([(0,)], "anchor long"), s.select("user_id"))
    assert balls.count() == 4 and peel.anchored_rings(e, s, balls, k_min=5).count() == 0 and peel.anchored_rings(e, s, balls, k_min=4).count() == 4


def test_lift_of_a_relation_without_fraud(spark):
    e = spark.createDataFrame([(2 * i, 2 * i + 1, 1 if i < 600 else 2) for i in range(1200)], "src long, dst long, relation_mask int")
    known = spark.createDataFrame([(v, int(v >= 1200 and v % 2)) for v in range(2400)], "user_id long, label int")
    got = {r.rel: (r.pairs, r.lift, r.alpha) for r in metrics.relation_lift(e, known).collect()}
    assert got["r1"] == (600, 1.0, 2.0) and got["r3"] == (600, 0.0, 0.0) and got["r6"] == (0, None, 1.0)


def test_running_sums_equal_a_window(spark):
    rows = [(i % 3, f"{i * 7919 % 1000:03x}", i % 5) for i in range(900)]
    df = spark.createDataFrame(rows, "g long, h string, v long")
    from ringloom.operators.running import hash_bucket, running_sum

    got = sorted((r.g, r.h, r.v, r.running, r.running_total) for r in running_sum(df, "v", hash_bucket("h"), ["h", "v"], ("g",)).collect())
    want = []
    for g in range(3):
        mine, so_far = sorted((h, v) for k, h, v in rows if k == g), 0
        for h, v in mine:
            so_far += v
            want.append((g, h, v, so_far, sum(v for _, v in mine)))
    assert got == sorted(want)


# fixpoints


def naive_cores(pairs, n):
    near = {v: set() for v in range(n)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    core, k = {}, 0
    left = {v: set(x) for v, x in near.items() if x}
    while left:
        v = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[v]))
        core[v] = k
        for u in left.pop(v):
            left[u].discard(v)
    return core


def test_cores_and_components(spark):
    rng = random.Random(3)
    pairs = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a < b}) + [(50, 51), (51, 52), (52, 53), (53, 54)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    twice = e.union(e.select("dst", "src"))
    for df, small in ((e, 30_000_000), (twice, 30_000_000), (twice, 0)):
        assert {r.user_id: r.core_number for r in iterate.core_numbers(df, small=small).collect()} == naive_cores(pairs, 60)
    root = {v: v for p in pairs for v in p}
    for _ in range(60):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    nodes = spark.createDataFrame([(99,)], "user_id long")
    assert {r.user_id: r.component for r in iterate.components(e, nodes).collect()} == root | {99: 99}


def test_propagation_equals_direct_solve(spark):
    rng = np.random.default_rng(0)
    n, h = 8, 0.02
    a = np.triu(rng.uniform(0.1, 1, (n, n)) * (rng.random((n, n)) < 0.6), 1)
    a += a.T
    phi = rng.choice([-0.01, 0, 0.01], n)
    x, c = iterate.propagation_constants(h)
    want = np.linalg.solve(np.eye(n) - c * a + x * np.diag(a.sum(1)), phi) + 0.5
    e = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(i + 1, n) if a[i, j]], "src long, dst long, weight double")
    got = iterate.propagate(e, spark.createDataFrame([(i, float(p)) for i, p in enumerate(phi)], "user_id long, phi double"), h, tolerance=1e-9).toPandas().sort_values("user_id")
    assert np.allclose(got.belief, want, atol=1e-6)
    with pytest.raises(ValueError):
        iterate.propagation_constants(0.5)


def test_terms_broadcast_or_joined_give_the_same_beliefs(spark):
    e = spark.createDataFrame([(i, (i * 7 + k) % 50, 0.1 * k) for i in range(50) for k in (1, 2, 3) if i < (i * 7 + k) % 50], "src long, dst long, weight float")
    prior = spark.createDataFrame([(i, 0.01 * (i % 3 - 1)) for i in range(50)], "user_id long, phi double")
    sent, joined = (iterate.propagate(e, prior, 0.02, rounds=4, sent=n).toPandas().sort_values("user_id").belief.to_numpy() for n in (1000, 0))
    assert np.allclose(sent, joined, atol=1e-14) and len(set(sent.round(9))) > 3


# tracking, cards, stress, sources


def test_life_cycle_over_three_nights(spark):
    def night(*groups):
        return spark.createDataFrame([(i, v) for i, g in enumerate(groups, 1) for v in g], "ring_id long, user_id long")

    t = Tracker(0.3)
    seen = []
    for n, groups in enumerate([[range(1, 11), range(20, 31)], [[*range(1, 11), 11], range(20, 26), range(26, 31), range(40, 51)], [[*range(1, 12), *range(40, 51)], range(20, 26)]], 1):
        seen.append(sorted((r.event, r.case_id) for r in t.observe(n, night(*groups)).collect()))
    assert [e for e, _ in seen[0]] == ["born", "born"]
    assert [e for e, _ in seen[1]] == ["born", "continued", "continued", "split"]
    assert sorted(e for e, _ in seen[2]) == ["continued", "died", "merged", "merged_into"]


def test_card_arm(spark):
    df = spark.createDataFrame([(1, None, "x", None, 0.0), (1, None, None, None, 30.0), (2, 5, "x", "m", None)], "card1 int, card2 int, DeviceInfo string, DeviceType string, dist1 double")
    for c in ("card3", "card5", "addr1", "addr2"):
        df = df.withColumn(c, F.lit(7))
    for c in ("P_emaildomain", "R_emaildomain", "id_31"):
        df = df.withColumn(c, F.lit(""))
    got = cards.relations(cards.fingerprint(df)).orderBy("account", "dist1").collect()
    assert [r.account for r in got] == [0, 0, 1]
    assert [r.device for r in got] == ["x|", None, "x|m"] and [r.place for r in got] == ["7|0", "7|3", "7|"]
    assert all(r.purchaser is None for r in got)
    lab = cards.account_labels(spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 1)], "account int, isFraud int"))
    assert {r.account: r.label for r in lab.collect()} == {0: 1, 1: 0, 2: 1}


def test_mutual_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (25, 8)) for c in ([0, 4, 8, 0, 0, 0, 1, 1], [4, 0, 0, 8, 0, 1, 0, 0], [8, 8, 0, 0, 4, 0, 0, 1])])
    got = stress.mutual_knn(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), k=3, blocks=4).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -np.inf)
    top = [set(np.argsort(-r)[:3]) for r in sim]
    assert set(zip(got.src, got.dst)) == {(i, j) for i in range(75) for j in top[i] if i < j and i in top[j]}


def test_fragments_and_split(spark):
    comps = spark.createDataFrame([(v, 1) for v in range(12)], "user_id long, component long")
    dealt = stress.cells(comps, 5)
    assert sorted(r.n for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()) == [4, 4, 4]
    e = spark.createDataFrame(clique(range(12), 1.0) + [(3, 50, 1.0)], "src long, dst long, weight double")
    assert stress.fragment(e, dealt).count() == 3 * 6 + 1
    nodes = spark.createDataFrame([(v, v % 3 - 1) for v in range(300)], "user_id long, label int")
    folds = {(r.label, r.fold): r.n for r in metrics.split(nodes).groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    assert folds == {(0, "test"): 25, (0, "val"): 15, (0, "train"): 60, (1, "test"): 25, (1, "val"): 15, (1, "train"): 60}


def test_sources(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_bytes(b"order_time,sku_id,id,r1,r2,r3,r4,r5,r6,r7,r8\r\n1000-05-20,5,0,123.0,,7.0,,,,1.0,\r\n1000-05-25,6,1,,,,,,2.0,,9.0\r\n")
    raw = readers.read_orders_csv(spark, str(p))
    readers.assert_empty(raw)
    with pytest.raises(ValueError):
        readers.assert_empty(raw, ("r1",))
    got = readers.load_orders(raw, raw, "1000-05-20", "1000-05-20").orderBy("week").collect()
    assert [(r.week, r.user_id, r.day_ordinal, r.r1, r.r8) for r in got] == [(1, 0, 365017, 123, None), (2, 1, 365022, None, 9)]
    nodes = spark.createDataFrame([(0, 1), (2, 0)], "user_id int, label int")
    with pytest.raises(ValueError):
        readers.load_nodes(nodes)
    assert readers.write_table(nodes, str(tmp_path / "n")) and not readers.write_table(nodes, str(tmp_path / "n"), force=False)


def test_empty_relation_gives_nothing(spark):
    o = spark.createDataFrame([(1, None), (2, None)], "user_id long, r1 long")
    assert graph.capped(graph.members(o, ("r1",))).count() == 0
    big = spark.createDataFrame([(v, 1) for v in range(150)], "user_id long, r1 long")
    assert graph.capped(graph.members(big, ("r1",))).count() == 0 and graph.entity_sizes(graph.members(big, ("r1",))).first().size == 150
    assert rings.label_counts(spark.createDataFrame([(1, 5)], "ring_id long, user_id long"), spark.createDataFrame([], "user_id long, label int")).first().precision is None


# queries against their SQL

CHECKED = ["neighbour_features", "ring_features", "decision_outcomes", "offer_table", "offer_random_precision", "ring_context", "blended_scores", "region_edges", "early_warnings", "ring_detection", "case_files", "burst_multipliers", "two_hop_closure", "anchor_balls", "account_split", "label_subsets", "account_edges", "top_accounts", "order_features", "graph_features", "propagated_beliefs", "relation_lift", "average_precision", "ring_evidence", "night_matching", "offer_ranking", "order_bursts", "ring_economics"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    a, b = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        if pd.api.types.is_numeric_dtype(a[c]):
            assert np.allclose(a[c].astype(float), b[c].astype(float), atol=2e-6, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c


# queries over all accounts and rings, without SQL


def test_pairs_are_dealt_by_their_first_account_in_lists(spark):
    """Edges equal those of single pairs, and no exchange is by pair: what is shuffled for them is a list an entity and account."""
    from ringloom.plans import ring_queries

    cap = graph.capped(graph.members(ring_queries.adapter.orders(spark, SF)))
    alphas = spark.createDataFrame([("r1", 2.0), ("r6", 0.5)], "rel string, alpha double")
    rows = lambda df: sorted((r.src, r.dst, round(r.weight, 4), r.n_relations, r.relation_mask, r.min_entity_size) for r in df.collect())
    assert rows(graph.fold_edges(cap, alphas)) == rows(graph.aggregate_edges(graph.relation_pairs(cap), alphas))
    plan = graph.fold_edges(cap)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(src#" in line and ", dst#" in line.split("hashpartitioning")[1]]


def test_packed_graph_equals_joined_pairs(spark):
    """Accounts far apart, negative and repeated, null entities, factors, accounts to leave out, rings in several blocks; what is dealt
    out are blocks, not pairs."""
    rng = random.Random(8)
    ids = [rng.randrange(-(2**40), 2**40) if v % 5 else v for v in range(120)]
    o = spark.createDataFrame([(rng.choice(ids), *(rng.randrange(-3, 9 * 4**i) if rng.random() < 0.8 else None for i in range(5))) for _ in range(2500)], "user_id long, r1 long, r3 long, r6 long, r7 long, r8 long")
    alphas = spark.createDataFrame([("r3", 2.5), ("r8", 0.3)], "rel string, alpha double")
    live = spark.createDataFrame([(v,) for v in ids[::2]], "user_id long")
    cap = graph.capped(graph.members(o), 30)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = graph.aggregate_edges(graph.relation_pairs(cap)).withColumn("weight", F.round("weight", 5)).cache()
    got = lambda **k: graph.build_graph(o, 30, **k).withColumn("weight", F.round("weight", 5))
    assert want.count() > 300 and rows(got()) == rows(want) and rows(got(among=live)) == rows(graph.induced(want, live))
    assert rows(got(alphas=alphas)) == rows(graph.aggregate_edges(graph.relation_pairs(cap), alphas).withColumn("weight", F.round("weight", 5)))
    m = spark.createDataFrame([(k, v) for k in range(40) for v in rng.sample(ids, 3 + k % 20)], "ring_id long, user_id long").repartition(4)
    totals = graph.inner_edges(want, m).groupBy("ring_id").agg(F.count("*").alias("pairs"), F.sum(F.col("weight").cast("double")).alias("weight"), F.bit_count(F.bit_or("relation_mask")).alias("k"), F.min("min_entity_size").alias("least"), F.avg((F.col("min_entity_size") <= 10).cast("double")).alias("rare"))
    got = graph.ring_totals(graph.account_tails(o, 30), m, 10)
    for a, b in zip(rows(got), rows(totals), strict=True):
        assert a == pytest.approx(b, abs=1e-3)
    for df in (got, graph.build_graph(o, 30)):
        dealt = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line]
        assert dealt and all("(slot#" in line or "(ring_id#" in line for line in dealt)
    empty = o.limit(0)
    assert graph.build_graph(empty).isEmpty() and graph.ring_totals(graph.account_tails(empty), m).isEmpty()


def test_ring_days_in_passes(spark):
    rng = random.Random(9)
    o = pd.DataFrame([(rng.randrange(20), rng.randrange(12), rng.choice([1.0, np.nan])) for _ in range(150)], columns=["user_id", "day_ordinal", "r6"])
    m = pd.DataFrame([(k, v) for k in range(50) for v in rng.sample(range(25), 9)], columns=["ring_id", "user_id"])
    d = m.merge(o, on="user_id").groupby(["ring_id", "day_ordinal"]).agg(k=("user_id", "size"), p=("r6", "count")).reset_index()
    want = {r: (g.k.sum(), g.p.sum(), g.k.max(), g.day_ordinal.min(), g.day_ordinal.max(), len(g)) for r, g in d.groupby("ring_id")}
    orders = spark.createDataFrame(o.astype({"r6": object}).where(o.notna(), None), "user_id long, day_ordinal long, r6 double")
    got = rings.ring_days(spark.createDataFrame(m), orders)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want and got._jdf.queryExecution().optimizedPlan().toString().count("Relation") > 1


def test_evidence_of_overlapping_rings_equals_brute_force(spark):
    """Forty rings of 3 to 16 of thirty accounts, several passes; of the entities that an account has alone only the first are laid out."""
    rng = random.Random(4)
    o = pd.DataFrame([(v, rng.randrange(90), v * 100 + i, rng.randrange(40), rng.randrange(12), rng.randrange(400)) for v in range(30) for i in range(20)], columns=["user_id", "r1", "r3", "r6", "r7", "r8"])
    m = {k: rng.sample(range(30), 3 + k % 14) for k in range(40)}
    got = rings.evidence(spark.createDataFrame([(k, v) for k, vs in m.items() for v in vs], "ring_id long, user_id long"), spark.createDataFrame(o), platform=0.5, top=5)
    has = {(b, r, e): set(g.user_id) for b, r in enumerate(("r1", "r3", "r6", "r7", "r8")) for e, g in o.groupby(r)}
    want = set()
    for k, vs in m.items():
        x = [(round(users / len(vs), 4), round(1 / np.log(2 + len(who)), 4), b, r, e, users, len(who)) for (b, r, e), who in has.items() if (users := len(who & set(vs))) / len(vs) >= 0.15 and len(who) <= 15]
        x.sort(key=lambda t: (-round(t[0] * t[1], 9), t[2], t[4]))
        want |= {(k, t[3], t[4], t[5], t[6], i) for i, t in enumerate(x[:5], 1)}
    assert {(r.ring_id, r.rel, r.entity, r.users, r.global_users, r.place) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_peeled_rings_are_found_once_and_on_the_pruned_graph(spark):
    """What is returned reads written rings, not the orders; pairs are made among live accounts only, with the whole graph's weights."""
    from ringloom.plans import ring_queries

    assert "l_partkey" not in ring_queries._peeled(spark, SF, "late")._jdf.queryExecution().optimizedPlan().toString()
    live = ring_queries._accounts(spark, SF).where("score > 0.5")
    o = ring_queries.adapter.orders(spark, SF)
    rows = lambda df: sorted((r.src, r.dst, round(r.weight, 4), r.relation_mask, r.min_entity_size) for r in df.collect())
    assert rows(graph.build_graph(o, among=live)) == rows(graph.prune(graph.build_graph(o), live, 0.5))


def test_decisions_read_the_queue_once_made(spark):
    assert "l_orderkey" not in registry.QUERIES["review_decisions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_both_halves_are_peeled_at_once(spark, monkeypatch):
    import threading

    from ringloom.plans import ring_queries

    both = threading.Barrier(2, timeout=20)
    monkeypatch.setattr(ring_queries, "_peeled", lambda s, d, half: (both.wait(), s.createDataFrame([(1, v) for v in range(5)], "ring_id long, user_id long"))[1])
    assert [tuple(r) for r in ring_queries.night_similarity(spark, SF).collect()] == [(1, 1, 5, 1.0)]


def test_nights_and_hostels_use_all_peeled_rings(spark):
    from ringloom.plans import ring_queries

    sets = lambda half: ring_queries._peeled(spark, SF, half).toPandas().groupby("ring_id").user_id.apply(set).to_dict()
    early, late, whole = sets("early"), sets("late"), sets(None)
    want = {(a, b): len(x & y) / len(x | y) for a, x in early.items() for b, y in late.items() if len(x & y) / len(x | y) >= 0.3}
    got = {(r.a, r.b): r.jaccard for r in registry.QUERIES["night_similarity"](spark, SF).collect()}
    assert early and late and got == pytest.approx(want, abs=1e-6)
    assert {r.case_id for r in registry.QUERIES["night_cases"](spark, SF).collect()} >= set(early) - {a for a, _ in want}
    mem = registry.QUERIES["hostel_clusters"](spark, SF).select("entity").join(graph.members(ring_queries.adapter.orders(spark, SF), ("r1",)), "entity").toPandas()
    inside = set().union(*whole.values())
    shares = mem.assign(k=mem.user_id.isin(inside) * 1.0).groupby("entity").k.mean().to_dict()
    assert {r.entity: r.share_in_ring for r in registry.QUERIES["hostel_test_peeled"](spark, SF).collect()} == pytest.approx(shares, abs=1e-6)


def test_fraud_components_are_those_of_the_graph(spark):
    e = registry.QUERIES["account_edges"](spark, SF).toPandas()
    root = {v: v for v in registry.QUERIES["account_cards"](spark, SF).where("label = 'fraud'").toPandas().user_id}
    pairs = [(a, b) for a, b in zip(e.src, e.dst) if a in root and b in root]
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {v: c for v, c in root.items() if sum(x == c for x in root.values()) >= 5}
    assert want and {r.user_id: r.component for r in registry.QUERIES["fraud_components"](spark, SF).collect()} == want


def test_queries_run_at_the_reference_parameters(spark, monkeypatch):
    from ringloom.plans import graph_queries, ring_queries

    seen = {}
    monkeypatch.setattr(peel, "extract_rings", lambda *a, **k: seen.update(top_k=k.get("top_k", peel.SETTINGS.top_k)))
    monkeypatch.setattr(graph, "ball", lambda e, anchors, *a, **k: seen.update(anchors=anchors._jdf.queryExecution().optimizedPlan().toString()))
    monkeypatch.setattr(peel, "anchored_rings", lambda *a, **k: None)
    monkeypatch.setattr(graph_queries.stress, "sample_neighbours", lambda e, s, fans: seen.update(fans=fans))
    monkeypatch.setattr(graph_queries.bursts, "null_by_size", lambda *a, draws: seen.update(draws=draws))
    monkeypatch.setattr(graph_queries.bursts, "burst_z", lambda *a: None)
    for f in (ring_queries.peeled_rings, ring_queries.anchored_rings, graph_queries.neighbour_sample, graph_queries.burst_z_table):
        f(spark, SF)
    assert "Limit 500" in seen["anchors"] and (seen["top_k"], seen["fans"], seen["draws"]) == (25, (15, 10), 400)
