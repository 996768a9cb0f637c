"""Queries: ring evaluation, evidence, hostels, offers, tracking, policy, metrics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ringloom.operators import graph, iterate, metrics, peel, policy, rings
from ringloom.sources import adapter

from . import common
from .common import BASE, EDGE_RINGS, EDGES, MEMBERS, RANKED, RINGS, edges, ranked_rings, rounded
from .registry import query


def _accounts(spark, sf_dir):
    return adapter.accounts(spark, sf_dir)


def _value(spark, sf_dir):
    return adapter.orders(spark, sf_dir).groupBy("user_id").agg((F.count("*") * 400.0).alias("value"))


_SPLIT = BASE + ", h as (select user_id, label, row_number() over (partition by label order by md5('20260902:' || user_id::varchar), user_id) as r, count(*) over (partition by label) as n from accounts_ where label >= 0), s as (select *, round_even(n * 0.25::double, 0) as t from h), folds_ as (select user_id, label, case when r <= t then 'test' when r <= t + round_even((n - t) * 0.2::double, 0) then 'val' else 'train' end as fold from s)"


@query(_SPLIT + " select user_id, label::bigint as label, fold from folds_")
def account_split(spark, sf_dir):
    """Stratified train, validation and test accounts."""
    return rounded(metrics.split(_accounts(spark, sf_dir)))


@query(_SPLIT + ", p as (select user_id, label, row_number() over (partition by label order by md5('20260902:' || user_id::varchar), user_id) as r, count(*) over (partition by label) as n from folds_ where fold = 'train') select f::double as fraction, user_id, label::bigint as label from p, (select unnest([0.01, 0.1, 0.5, 1.0]::double[]) as f) where r <= greatest(round_even(n * f, 0), 1)")
def label_subsets(spark, sf_dir):
    """Nested stratified label budgets."""
    return rounded(metrics.label_subsets(metrics.split(_accounts(spark, sf_dir)).where("fold = 'train'").select("user_id", "label"), (0.01, 0.1, 0.5, 1.0)))


_CURVE = BASE + ", g as (select score, sum(label) as p, count(*) as n from accounts_ where label >= 0 group by 1), c as (select score, sum(p) over w as tp, sum(n - p) over w as fp, sum(p) over () as a from g window w as (order by score desc)), c2 as (select score, tp, fp, tp / (tp + fp) as precision, tp / a as recall from c)"


@query(_CURVE + " select round(score + 1e-9, 6) as score, tp::bigint as tp, fp::bigint as fp, round(precision + 1e-9, 6) as precision, round(recall + 1e-9, 6) as recall from c2")
def precision_recall_curve(spark, sf_dir):
    """The precision-recall curve of the score."""
    return rounded(metrics.curve(_accounts(spark, sf_dir)))


@query(_CURVE + ", d as (select *, recall - coalesce(lag(recall) over (order by score desc), 0) as step from c2) select round(sum(step * precision) + 1e-9, 6) as average_precision, max(tp)::bigint as positives, max(fp)::bigint as negatives from d")
def average_precision(spark, sf_dir):
    """Average precision of the score."""
    return rounded(metrics.average_precision(_accounts(spark, sf_dir)))


@query(BASE + ", c as (select count(*) filter (where score >= 0.5 and label = 1) as tp, count(*) filter (where score >= 0.5 and label = 0) as fp, count(*) filter (where score < 0.5 and label = 1) as fn, count(*) filter (where score < 0.5 and label = 0) as tn from accounts_ where label >= 0) select tp, fp, fn, tn, round(tp / (tp + fp) + 1e-9, 6) as precision, round(tp / (tp + fn) + 1e-9, 6) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) + 1e-9, 6) as f1, round(fp / tp + 1e-9, 6) as fp_per_tp from c")
def confusion(spark, sf_dir):
    """Confusion metrics at 0.5."""
    return rounded(metrics.binary_metrics(_accounts(spark, sf_dir), 0.5))


@query(_CURVE + " select t as target, round(min(score) + 1e-9, 6) as threshold from (select unnest([0.05, 0.12, 0.8]::double[]) as t) left join c2 on precision >= t group by 1")
def operating_points(spark, sf_dir):
    """The lowest thresholds that reach target precisions."""
    return rounded(metrics.operating_points(_accounts(spark, sf_dir), (0.05, 0.12, 0.8)))


@query(_CURVE + ", f as (select score, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 9) as f1 from c2) select round(score + 1e-9, 6) as threshold, round(f1 + 1e-9, 6) as f1 from f order by f.f1 desc, score limit 1")
def best_f1(spark, sf_dir):
    """The threshold of the best F1."""
    return rounded(metrics.best_f1(_accounts(spark, sf_dir)))


@query(BASE + " select round(min(score) + 1e-9, 6) as threshold from (select score from accounts_ order by score desc limit 100)")
def flag_threshold(spark, sf_dir):
    """The threshold that flags a budget of 100."""
    return rounded(metrics.flag_threshold(_accounts(spark, sf_dir), 100))


@query(BASE + ", r as (select *, row_number() over (order by score desc, user_id) as r from accounts_) select k::bigint as k, count(*) filter (where label >= 0) as labelled, count(*) filter (where label = 1) as fraud, round(count(*) filter (where label = 1) / count(*) filter (where label >= 0) + 1e-9, 6) as precision from r, (select unnest([100, 500, 1000]) as k) where r <= k group by 1")
def precision_at_k(spark, sf_dir):
    """Precision of the top k accounts."""
    return rounded(metrics.precision_at_k(_accounts(spark, sf_dir), (100, 500, 1000)))


@query(
    EDGES
    + ", bits(rel, bit) as (values ('r1', 0), ('r3', 1), ('r6', 2), ('r7', 3), ('r8', 4)), m as (select rel, a.label::double as l1, b.label::double as l2 from edges_ join accounts_ a on a.user_id = src and a.label >= 0 join accounts_ b on b.user_id = dst and b.label >= 0 join bits on (relation_mask >> bit) & 1 = 1), s as (select rel, count(*) as pairs, avg(l1 * l2) as ff, avg((l1 + l2) / 2) as p from m group by 1), l as (select bits.rel, coalesce(pairs, 0) as pairs, ff, p, case when pairs >= 500 then case when p > 0 then ff / (p * p) else 1 end end as lift from bits left join s on s.rel = bits.rel) select rel, pairs, round(ff + 1e-9, 6) as ff_rate, round(p + 1e-9, 6) as p, round(lift + 1e-9, 6) as lift, round(coalesce(lift / avg(lift) over (), 1) + 1e-9, 6) as alpha from l"
)
def relation_lift(spark, sf_dir):
    """How much oftener than by chance both ends of an edge are fraud, by relation."""
    return rounded(metrics.relation_lift(edges(spark, sf_dir), _accounts(spark, sf_dir).where("label >= 0")))


@query(BASE + " select user_id, round(score * (1 + context) + 1e-9, 6) as boosted, round(score + 1e-6::double * context, 9) as tie_break from (select user_id, score, ((user_id % 7) / 7.0::double) / max((user_id % 7) / 7.0::double) over () as context from accounts_)")
def blended_scores(spark, sf_dir):
    """Scores blended with a context share."""
    b = rings.blend(_accounts(spark, sf_dir).withColumn("context", (F.col("user_id") % 7) / 7.0))
    return b.select("user_id", F.round(F.col("boosted") + 1e-9, 6).alias("boosted"), F.round("tie_break", 9).alias("tie_break"))


_COUNTS = ", j as (select ring_id, user_id, label from rings_ left join accounts_ using (user_id)) select ring_id, count(*) as size, count(*) filter (where label = 1) as fraud, count(*) filter (where label = 0) as normal, count(*) filter (where label < 0) as unknown, round(count(*) filter (where label = 1) / nullif(count(*) filter (where label >= 0), 0) + 1e-9, 6) as precision from j group by 1"


@query(RINGS + _COUNTS)
def ring_label_counts(spark, sf_dir):
    """Labels of each ring's members."""
    return rounded(rings.label_counts(common.rings(spark, sf_dir), _accounts(spark, sf_dir)))


@query(
    RINGS
    + """, v as (select user_id, count(*) * 400.0::double as value from orders_ group by 1), m as (select distinct user_id from rings_), a as (select count(*) as accounts, count(*) filter (where label = 1) as fraud, count(*) filter (where label = 0) as normal, count(*) filter (where label < 0) as unknown, sum(case when label = 0 then coalesce(value, 0) else 0 end) as fp_cost from m left join accounts_ using (user_id) left join v using (user_id)),
z as (select count(*) as rings, min(n) as size_min, quantile_cont(n, 0.5) as size_median, max(n) as size_max from (select ring_id, count(*) as n from rings_ group by 1))
select rings, accounts, fraud, normal, unknown, round(fraud / (fraud + normal) + 1e-9, 6) as precision, round(fraud / (select count(*) from accounts_ where label = 1) + 1e-9, 6) as recall, round(normal / fraud + 1e-9, 6) as normal_per_fraud, round(fp_cost + 1e-9, 6) as fp_cost, size_min, size_median, size_max, fraud + normal < 30 as small_sample from a, z"""
)
def ring_evaluation(spark, sf_dir):
    """All rings against labels and values."""
    return rounded(rings.evaluate(common.rings(spark, sf_dir), _accounts(spark, sf_dir), _value(spark, sf_dir)))


@query(
    EDGE_RINGS
    + """, n as (select ring_id, count(*) as size, sum(score) as mass from rings_ join accounts_ using (user_id) group by 1), w as (select a.ring_id, sum(weight::double) as weight from edges_ join rings_ a on a.user_id = src join rings_ b on b.user_id = dst and b.ring_id = a.ring_id group by 1)
select ring_id, size, round(mass + 1e-9, 6) as score_mass, round(coalesce(weight, 0) + 1e-9, 6) as internal_weight, round((coalesce(weight, 0) + 5 * mass) / size + 1e-9, 6) as density from n left join w using (ring_id)"""
)
def ring_totals(spark, sf_dir):
    """Internal weight, score mass and density of each ring."""
    return rounded(graph.subgraph_totals(edges(spark, sf_dir), common.rings(spark, sf_dir), _accounts(spark, sf_dir).select("user_id", "score"), 5.0))


_CLUSTERS = ", cl as (select entity, count(*) as size, count(*) filter (where label >= 0) as labelled, count(*) filter (where label = 0) as normal from members_ join accounts_ using (user_id) where rel = 'r1' group by 1 having count(*) between 8 and 100 and count(*) filter (where label >= 0) >= 3), clusters_ as (select entity, size, labelled, normal, normal / labelled as normal_share from cl where normal / labelled >= 0.8)"


@query(MEMBERS + _CLUSTERS + " select entity, size, labelled, normal, round(normal_share + 1e-9, 6) as normal_share from clusters_")
def hostel_clusters(spark, sf_dir):
    """Groups at one place that are mostly normal."""
    return rounded(rings.colocated_clusters(graph.members(adapter.orders(spark, sf_dir), ("r1",)), _accounts(spark, sf_dir), "r1", least=8))


@query(
    EDGE_RINGS
    + _CLUSTERS
    + """, last_ as (select user_id, max(entity) as entity from members_ join clusters_ using (entity) where rel = 'r1' group by 1), inr as (select distinct user_id, 1.0::double as k from capped_ where rel = 'r8' and size >= 4),
p as (select entity, avg(coalesce(k, 0)) as share_in_ring, avg(score) as mean_score, max(score) as max_score from members_ join clusters_ using (entity) join accounts_ using (user_id) left join inr using (user_id) where rel = 'r1' group by 1),
e as (select a.entity, count(*) as n, bit_count(bit_or(relation_mask)) as d from edges_ join last_ a on a.user_id = src join last_ b on b.user_id = dst and b.entity = a.entity group by 1)
select entity, size, labelled, normal, round(normal_share + 1e-9, 6) as normal_share, round(share_in_ring + 1e-9, 6) as share_in_ring, round(mean_score + 1e-9, 6) as mean_score, round(max_score + 1e-9, 6) as max_score, coalesce(n, 0) as internal_edges, coalesce(d, 0)::bigint as relation_diversity from clusters_ join p using (entity) left join e using (entity)"""
)
def hostel_test(spark, sf_dir):
    """How flagged hostels are, and by what they are linked."""
    mem = graph.members(adapter.orders(spark, sf_dir))
    cl = rings.colocated_clusters(mem, _accounts(spark, sf_dir), "r1", least=8)
    groups = graph.capped(mem.where("rel = 'r8'"), least=4).select(F.col("entity").alias("ring_id"), "user_id")
    return rounded(rings.hostel_test(cl, mem, "r1", edges(spark, sf_dir), _accounts(spark, sf_dir), groups))


@query(
    RINGS
    + """, ids as (select max(user_id) + 1 as top from orders_), n as (select ring_id, count(*) as n from rings_ group by 1), g as (select ring_id, rel, bit, entity, count(*) as users from rings_ join members_ using (user_id) group by all),
s as (select ring_id, rel, bit, entity, users, round_even(users / n, 4) as coverage, size as global_users, round_even(1 / ln(2.0::double + size), 4) as rarity from g join n using (ring_id) join sizes_ using (rel, entity), ids where users / n >= 0.15 and size <= 0.05::double * top)
select ring_id, rel, entity, users, round(coverage + 1e-9, 6) as coverage, global_users, round(rarity + 1e-9, 6) as rarity, place from (select *, row_number() over (partition by ring_id order by round(coverage * rarity, 9) desc, bit, entity) as place from s) where place <= 12"""
)
def ring_evidence(spark, sf_dir):
    """What a ring's members share and few others do."""
    return rounded(rings.evidence(common.rings(spark, sf_dir), adapter.orders(spark, sf_dir)))


@query(RINGS + ", d as (select ring_id, day_ordinal, count(*) as k, count(r6) as p from rings_ join orders_ using (user_id) group by all) select ring_id, sum(k)::bigint as n_orders, sum(p)::bigint as n_promo_orders, round(max(k) / sum(k) + 1e-9, 6) as top_day_share, sum(p) * 100.0::double as subsidy, sum(k) * 400.0::double as order_value from d group by 1")
def ring_orders(spark, sf_dir):
    """Orders, promotions and their money of each ring."""
    return rounded(rings.ring_orders(common.rings(spark, sf_dir), adapter.orders(spark, sf_dir)))


@query(RINGS + ", lim as (select max(day_ordinal) as hi from orders_), x as (select ring_id, day_ordinal, count(*) as n from rings_ join orders_ using (user_id), lim where r6 is not null and day_ordinal > hi - 30 group by all), g as (select ring_id, unnest(range(hi - 29, hi + 1)) as day_ordinal from (select distinct ring_id from rings_), lim) select ring_id, day_ordinal, coalesce(n, 0) as promo_orders from g left join x using (ring_id, day_ordinal)")
def promo_by_day(spark, sf_dir):
    """Promotion orders of each ring on each of the last 30 days, zeros too."""
    o = adapter.orders(spark, sf_dir)
    hi = o.agg(F.max("day_ordinal")).first()[0]
    return rings.promo_by_day(common.rings(spark, sf_dir), o, hi - 29, hi)


@query(
    EDGE_RINGS
    + """, s as (select ring_id, count(*)::double as size, sum(score) as mass, avg(score) as m, quantile_cont(score, 0.5) as md, min(score) as mn, quantile_cont(score, 0.1) as p10, stddev_pop(score) as sd from rings_ join accounts_ using (user_id) group by 1),
e as (select a.ring_id, count(*) as pairs, sum(weight::double) as w, avg((min_entity_size <= 10)::int) as rs, min(min_entity_size) as es, bit_count(bit_or(relation_mask)) as kinds from edges_ join rings_ a on a.user_id = src join rings_ b on b.user_id = dst and a.ring_id = b.ring_id group by 1),
dd as (select ring_id, day_ordinal, count(*) as k, count(r6) as p from rings_ join orders_ using (user_id) group by all),
d as (select ring_id, sum(k)::double as orders, sum(p) as promo, max(k) as top, (max(day_ordinal) - min(day_ordinal) + 1)::double as span, count(*) as days from dd group by 1),
f as (select ring_id, size, (coalesce(w, 0) + 5 * mass) / size as density, coalesce(w, 0) / size as internal_weight_per_member, mass / size as score_mass_per_member, coalesce(kinds, 0)::double as relation_kinds, coalesce(pairs, 0) / greatest(size * (size - 1) / 2, 1) as top_entity_coverage, coalesce(es, 0)::double as top_entity_platform_count, case when es > 0 then 1 / ln(2.0::double + es) else 0 end as top_entity_rarity, coalesce(rs, 0) as rare_edge_share,
 m as score_mean, md as score_median, mn as score_min, p10 as score_p10, sd as score_std, orders / size as orders_per_member, promo / greatest(orders, 1) as promo_share, top / orders as busiest_day_share, span as day_span, days / size as active_days_per_member, 0.5::double as tau, 5.0::double as "lambda" from s left join e using (ring_id) join d using (ring_id))
select ring_id, """
    + ", ".join(f'round({c} + 1e-9, 6) as {c}' for c in (f'"{x}"' if x == "lambda" else x for x in rings.RING_FEATURES))
    + " from f"
)
def ring_features(spark, sf_dir):
    """The 21 label-free features of each ring."""
    o = iterate.cut(adapter.orders(spark, sf_dir).drop("sku_id"))
    given = graph.capped(graph.members(o, ("r1",)), least=5).select(F.col("entity").alias("ring_id"), "user_id")
    return rounded(rings.ring_features(given, None, _accounts(spark, sf_dir), o, tails=graph.account_tails(o)))


_NIGHTS = (
    MEMBERS
    + """, days_ as (select day_ordinal, row_number() over (order by day_ordinal) as k, count(*) over () as n from (select distinct day_ordinal from orders_)),
f0 as (select distinct r1 as ring_id, user_id from orders_ join days_ using (day_ordinal) where k <= n // 2 and r1 is not null),
fronts_ as (select * from f0 where ring_id in (select ring_id from f0 group by 1 having count(*) between 5 and 100)),
t as (select distinct entity // 2 as ring_id, user_id from capped_ where rel = 'r1' and size >= 5), tonight_ as (select ring_id, user_id from t where ring_id in (select ring_id from t group by 1 having count(*) >= 8)),
k as (select f.ring_id as a, t.ring_id as b, count(*) as shared from fronts_ f join tonight_ t using (user_id) group by all), sim_ as (select a, b, shared, shared / (n + m - shared) as jaccard from k join (select ring_id as a, count(*) as n from fronts_ group by 1) using (a) join (select ring_id as b, count(*) as m from tonight_ group by 1) using (b) where shared / (n + m - shared) >= 0.3)"""
)


def _nights(spark, sf_dir):
    """r1 groups of the early days, and tonight's, two neighbouring ones of all days as one."""
    o = adapter.orders(spark, sf_dir)
    early = graph.windows(o).where("half = 'early'").select("day_ordinal")
    fronts = graph.capped(graph.members(o.join(F.broadcast(early), "day_ordinal", "left_semi"), ("r1",)), least=5).select(F.col("entity").alias("ring_id"), "user_id")
    tonight = common.rings(spark, sf_dir).select(F.expr("ring_id div 2").alias("ring_id"), "user_id").distinct()
    ok = tonight.groupBy("ring_id").agg(F.count("*").alias("n")).where("n >= 8").select("ring_id")
    return fronts, tonight.join(ok, "ring_id", "left_semi")


@query(_NIGHTS + " select a, b, shared, round(jaccard + 1e-9, 6) as jaccard from sim_")
def ring_similarity(spark, sf_dir):
    """Rings of two nights that are alike."""
    return rounded(rings.ring_similarity(*_nights(spark, sf_dir), 0.3))


@query(
    _NIGHTS
    + """, s as (select *, row_number() over (partition by b order by jaccard desc, a) as pred, row_number() over (partition by a order by jaccard desc, b) as succ, count(*) over (partition by b) as many from sim_),
ev as (select r.ring_id, a, case when a is null then 'born' when succ > 1 then 'split' when many > 1 then 'merged' else 'continued' end as event from (select distinct ring_id from tonight_) r left join (select * from s where pred = 1) x on x.b = r.ring_id),
now_ as (select case when event in ('born', 'split') then 10000000 + sum((event in ('born', 'split'))::int) over (order by ring_id) - 1 else a end::bigint as case_id, ring_id, event from ev)
select * from now_ union all
select f.ring_id, s.b, case when s.b is null then 'died' else 'merged_into' end from (select distinct ring_id from fronts_) f left join (select a, b from s where succ = 1) s on s.a = f.ring_id where f.ring_id not in (select case_id from now_ where event in ('continued', 'merged'))"""
)
def night_matching(spark, sf_dir):
    """Which of tonight's rings are yesterday's cases."""
    return rings.match_night(*_nights(spark, sf_dir), 0.3, 10_000_000)


@query(RANKED + ", f as (select user_id, min(rank) as rank from ranked_ where rank <= 50 group by 1), n as (select rank, count(*) as n from f group by 1) select r.rank, (sum(coalesce(n, 0)) over (order by r.rank))::bigint as covered from (select distinct rank from ranked_ where rank <= 50) r left join n using (rank)")
def coverage_curve(spark, sf_dir):
    """Accounts that the top rings cover."""
    return rounded(rings.coverage_curve(ranked_rings(spark, sf_dir)))


@query(RANKED + ", f as (select user_id, min(rank) as rank from ranked_ group by 1) select d::bigint as depth, count(*) as accounts, count(*) filter (where label >= 0) as labelled, count(*) filter (where label = 1) as fraud, round(count(*) filter (where label = 1) / count(*) filter (where label >= 0) + 1e-9, 6) as precision from f join accounts_ using (user_id), (select unnest([25, 100, 200]) as d) where rank <= d group by 1")
def precision_at_depth(spark, sf_dir):
    """Precision of the first 25, 100 and 200 rings."""
    return rounded(rings.precision_at_depth(ranked_rings(spark, sf_dir), _accounts(spark, sf_dir)))


@query(RANKED + ", f as (select user_id, min(rank) as rank from ranked_ group by 1), k as (select *, row_number() over (order by rank, user_id) as r from f) select b::bigint as budget, count(*) filter (where label >= 0) as labelled, count(*) filter (where label = 1) as fraud, round(count(*) filter (where label = 1) / count(*) filter (where label >= 0) + 1e-9, 6) as precision from k join accounts_ using (user_id), (select unnest([250, 500, 1000]) as b) where r <= b group by 1")
def precision_at_budget(spark, sf_dir):
    """Precision of the first accounts in ring order."""
    return rounded(rings.precision_at_budget(ranked_rings(spark, sf_dir), _accounts(spark, sf_dir), (250, 500, 1000)))


_OFFERS = (
    RANKED
    + """, act as (select floor(0.1::double * count(distinct user_id)) as most from orders_), inside_ as (select distinct user_id from ranked_), x as (select rel, entity, user_id from members_ where rel in ('r6', 'r7', 'r8')),
g as (select rel, entity, count(*) as redeemers, count(i.user_id) as in_ring, round(avg(score) + 1e-9, 6) as mean_score, round(quantile_cont(score, 0.9) + 1e-9, 6) as p90_score, count(*) filter (where label >= 0) as labelled, count(*) filter (where label = 1) as fraud from x join accounts_ using (user_id) left join inside_ i using (user_id) group by all),
several as (select rel, entity, count(distinct ring_id) as rings from x join ranked_ using (user_id) group by all),
offers_ as (select rel, entity, redeemers, in_ring, coalesce(rings, 0) as rings, round_even(in_ring / redeemers, 6) as ring_share, mean_score, p90_score, redeemers * 100.0::double as stake, labelled, fraud, case when labelled > 0 then round_even(fraud / labelled, 4) end as fraud_share from g left join several using (rel, entity), act where redeemers between 5 and most)"""
)
_OFFER_COLUMNS = "rel, entity, redeemers, in_ring, rings, round(ring_share + 1e-9, 6) as ring_share, round(mean_score + 1e-9, 6) as mean_score, round(p90_score + 1e-9, 6) as p90_score, stake, labelled, fraud, round(fraud_share + 1e-9, 6) as fraud_share"
_TOP = ", r as (select *, row_number() over (order by {by} desc, redeemers desc, entity, rel) as rank from offers_)"
_OFFER_PRECISION = _TOP + ", x2 as (select rank, user_id from r join x using (rel, entity) where rank <= 50), f as (select user_id, min(rank) as rank from x2 group by 1) select k::bigint as depth, count(*) as accounts, count(*) filter (where label >= 0) as labelled, count(*) filter (where label = 1) as fraud, round(count(*) filter (where label = 1) / count(*) filter (where label >= 0) + 1e-9, 6) as precision from f join accounts_ using (user_id), (select unnest([10, 25, 50]) as k) where rank <= k group by 1"


def _offers(spark, sf_dir):
    a = _accounts(spark, sf_dir)
    return rings.offers(adapter.orders(spark, sf_dir), a, a, ranked_rings(spark, sf_dir))


def _offer_precision(spark, sf_dir, by):
    top = rings.rank_offers(_offers(spark, sf_dir), 50, by).select("rank", "rel", "entity")
    m = graph.members(adapter.orders(spark, sf_dir), ("r6", "r7", "r8")).select("rel", "entity", "user_id")
    return rounded(rings.precision_at_depth(m.join(F.broadcast(top), ["rel", "entity"]), _accounts(spark, sf_dir), (10, 25, 50)))


@query(_OFFERS + f" select {_OFFER_COLUMNS} from offers_")
def offer_table(spark, sf_dir):
    """Offers with who redeems them."""
    return rounded(_offers(spark, sf_dir))


@query(MEMBERS + ", act as (select floor(0.1::double * count(distinct user_id)) as most from orders_) select rel, count(*) filter (where size < 5) as too_small, count(*) filter (where size >= 5 and size > most) as platform_default from sizes_, act where rel in ('r6', 'r7', 'r8') group by 1")
def offer_exclusions(spark, sf_dir):
    """Entities that are no offers, by why."""
    return rings.offer_exclusions(adapter.orders(spark, sf_dir))


@query(_OFFERS + _TOP.format(by="ring_share") + f" select {_OFFER_COLUMNS}, rank from r where rank <= 50")
def offer_ranking(spark, sf_dir):
    """The 50 offers with the largest share of redeemers in rings."""
    return rounded(rings.rank_offers(_offers(spark, sf_dir), 50))


@query(_OFFERS + _TOP.format(by="mean_score") + f" select {_OFFER_COLUMNS}, rank from r where rank <= 50")
def offer_ranking_by_score(spark, sf_dir):
    """The 50 offers with the highest mean score of redeemers."""
    return rounded(rings.rank_offers(_offers(spark, sf_dir), 50, "mean_score"))


@query(_OFFERS + _OFFER_PRECISION.format(by="ring_share"))
def offer_precision(spark, sf_dir):
    """Pooled precision over the accounts of the top offers by ring share."""
    return _offer_precision(spark, sf_dir, "ring_share")


@query(_OFFERS + _OFFER_PRECISION.format(by="mean_score"))
def offer_precision_by_score(spark, sf_dir):
    """Pooled precision over the accounts of the top offers by mean score."""
    return _offer_precision(spark, sf_dir, "mean_score")


@query(
    _OFFERS
    + """, h as (select draw, rel, entity, md5('20260902:' || draw::varchar || ':' || rel || ':' || entity::varchar) as h from offers_, (select unnest(range(1, 201)) as draw)),
drawn as (select * from (select *, row_number() over (partition by draw order by h, rel, entity) as rank from h) where rank <= 50),
f as (select draw, user_id, min(rank) as rank from drawn join x using (rel, entity) group by all),
p as (select k as depth, draw, avg(label) as precision from f join accounts_ using (user_id), (select unnest([10, 25, 50]) as k) where label >= 0 and rank <= k group by all)
select depth::bigint as depth, count(*) as draws, round(avg(precision) + 1e-9, 6) as mean, round(min(precision) + 1e-9, 6) as least, round(max(precision) + 1e-9, 6) as most from p where (select count(*) from offers_) > depth group by 1"""
)
def offer_random_precision(spark, sf_dir):
    """Pooled precision of 200 random draws of as many offers."""
    m = graph.members(adapter.orders(spark, sf_dir), ("r6", "r7", "r8")).select("rel", "entity", "user_id")
    return rounded(rings.random_precision(_offers(spark, sf_dir), m, _accounts(spark, sf_dir)))


@query(
    EDGE_RINGS
    + """, early as (select user_id, max(1 - (ring_id % 1000) / 1000.0::double) as confidence from rings_ group by 1),
w as (select node as user_id, count(e.user_id) as neighbours, count(*) filter (where min_entity_size <= 10) as rare, count(e.user_id) filter (where min_entity_size <= 10) as rare_hit from ways_ left join early e on e.user_id = nbr group by 1)
select a.user_id, (confidence is not null)::int::double as in_previous_ring, round(coalesce(confidence, 0) + 1e-9, 6) as previous_ring_confidence, coalesce(neighbours, 0) as neighbours_in_previous_rings, round(case when rare > 0 then rare_hit / rare else 0 end + 1e-9, 6) as rare_entity_overlap_with_previous_rings from accounts_ a left join early using (user_id) left join w on w.user_id = a.user_id"""
)
def ring_context(spark, sf_dir):
    """What an account has to do with given earlier rings."""
    early = common.rings(spark, sf_dir).groupBy("user_id").agg(F.max(1 - (F.col("ring_id") % 1000) / 1000.0).alias("confidence"))
    return rounded(rings.ring_context(early, edges(spark, sf_dir), _accounts(spark, sf_dir)))


@query(MEMBERS + ", f as (select rel, entity, min(day_ordinal) as first_seen from (select 'r6' as rel, r6 as entity, day_ordinal from orders_ union all select 'r7', r7, day_ordinal from orders_) where entity is not null group by all) select rel, entity, rel || '-' || case when k < 10000 then lpad(k::varchar, 4, '0') else left(k::varchar, 4) end as name from (select *, row_number() over (partition by rel order by first_seen, entity) as k from f)")
def entity_names(spark, sf_dir):
    """Short stable names for offers and coupons."""
    o = graph.long_form(adapter.orders(spark, sf_dir), ("r6", "r7"), ("day_ordinal",))
    return rings.labels_for(o.groupBy("rel", "entity").agg(F.min("day_ordinal").alias("first_seen")))


_ECONOMICS = (
    RINGS
    + """, v as (select user_id, count(*) * 400.0::double as value, count(r6) * 100.0::double as stake from orders_ group by 1),
eco_ as (select ring_id, count(*) as size, avg(score) as p, sum(coalesce(stake, 0)) as value_at_stake, sum((1 - score) * coalesce(value, 0)) as legitimate_exposed, count(*) filter (where label = 1) as realised_fraud, count(*) filter (where label = 0) as realised_normal, sum(case when label = 1 then coalesce(stake, 0) else 0 end) as realised_stake, sum(case when label = 0 then coalesce(value, 0) else 0 end) as realised_harm, greatest(1, round_even(3 + 0.25::double * count(*), 0)::bigint) as review_minutes from rings_ join accounts_ using (user_id) left join v using (user_id) group by 1)"""
)


def _economics(spark, sf_dir):
    v = adapter.orders(spark, sf_dir).groupBy("user_id").agg((F.count("*") * 400.0).alias("value"), (F.count("r6") * 100.0).alias("stake"))
    return policy.economics(common.rings(spark, sf_dir), _accounts(spark, sf_dir).join(v, "user_id", "left"))


@query(_ECONOMICS + " select ring_id, size, round(p + 1e-9, 6) as p, round(value_at_stake + 1e-9, 6) as value_at_stake, round(legitimate_exposed + 1e-9, 6) as legitimate_exposed, realised_fraud, realised_normal, round(realised_stake + 1e-9, 6) as realised_stake, round(realised_harm + 1e-9, 6) as realised_harm, review_minutes, round(p * value_at_stake + 1e-9, 6) as review_value, round(p * value_at_stake - (1 - p) * legitimate_exposed * 0.1::double + 1e-9, 6) as hold_value from eco_")
def ring_economics(spark, sf_dir):
    """What reviewing or holding each ring is worth."""
    return rounded(policy.expected_values(_economics(spark, sf_dir), 0.1))


@query(
    _ECONOMICS
    + """, g as (select unnest(['hold_all', 'density', 'none']) as policy, unnest([1.0, 0.9, 0.0]::double[]) as stops, unnest([0.1, 0.01, 0.0]::double[]) as harms, unnest([0, 1, 0]) as looks),
x as (select policy, sum(looks)::bigint as reviewed, sum((policy = 'hold_all')::int)::bigint as held, sum(looks * review_minutes)::bigint as minutes, sum(stops * realised_stake) as stopped, sum(harms * realised_harm) as harmed, sum(realised_stake) as all_stake from eco_, g group by 1)
select 1::bigint as night, 120::bigint as budget, policy, reviewed, held, minutes, round(stopped + 1e-9, 6) as stopped, round(harmed + 1e-9, 6) as harmed, minutes * 10.0::double as analyst_cost, round(stopped - harmed - minutes * 10 + 1e-9, 6) as net, round(1 - (all_stake - stopped + harmed + minutes * 10) / all_stake + 1e-9, 6) as savings from x"""
)
def decision_outcomes(spark, sf_dir):
    """What holding all rings, reviewing all at an accuracy of 0.9, and doing nothing come to."""
    e = _economics(spark, sf_dir).withColumn("night", F.lit(1).cast("long"))
    chosen = e.select("night", F.lit(120).cast("long").alias("budget"), "ring_id", F.explode(F.array(F.struct(F.lit("hold_all").alias("policy"), F.lit("hold").alias("action")), F.struct(F.lit("density").alias("policy"), F.lit("review").alias("action")))).alias("d")).select("night", "budget", "ring_id", "d.*")
    return rounded(policy.outcomes(chosen, e, 0.1, 0.9, (120,)).where("policy <> 'capacity'"))


def _queue(spark, sf_dir):
    """Peeled rings of a night with their economics."""
    r = _peeled(spark, sf_dir, density=True)
    o = adapter.orders(spark, sf_dir).join(F.broadcast(r.select("user_id").distinct()), "user_id", "left_semi")  # top_k * k_max accounts at most
    v = o.groupBy("user_id").agg((F.count("*") * 400.0).alias("value"), (F.count("r6") * 100.0).alias("stake"))
    eco = policy.economics(r, _accounts(spark, sf_dir).join(v, "user_id", "left")).join(r.select("ring_id", "density").distinct(), "ring_id")
    return policy.expected_values(eco, policy.CHURN).withColumn("night", F.lit(1).cast("long"))


@query()
def review_plans(spark, sf_dir):
    """What each policy reviews and holds of the peeled rings, at each budget of minutes."""
    return policy.plan(_queue(spark, sf_dir))


@query()
def review_outcomes(spark, sf_dir):
    """What the plans stop, harm and save; a test holds plans and outcomes against brute force."""
    queue = iterate.cut(_queue(spark, sf_dir))
    return rounded(policy.outcomes(policy.plan(queue), queue))


@query()
def review_decisions(spark, sf_dir):
    """Review, hold or ignore: the decision on each peeled ring."""
    return policy.decide(iterate.cut(_queue(spark, sf_dir)))


@query()
def peeled_rings(spark, sf_dir):
    """The densest groups of the pruned graph; tests hold the kernels against brute force."""
    live = _accounts(spark, sf_dir).where("score > 0.5").select("user_id", "score")
    return peel.extract_rings(graph.build_graph(adapter.orders(spark, sf_dir), among=live), live)


@query()
def anchored_rings(spark, sf_dir):
    """The densest group around each of the top 500 anchors."""
    a = _accounts(spark, sf_dir).where("score > 0.5")
    anchors = a.orderBy(F.desc("score"), "user_id").limit(500).select(F.col("user_id").alias("anchor"))
    e = graph.prune(edges(spark, sf_dir), a, 0.5)
    return peel.anchored_rings(e, a.select("user_id", "score"), graph.ball(e, anchors, a.select("user_id")))


@query(_OFFERS + " select rel, entity, redeemers, round(ring_share + 1e-9, 6) as ring_share from offers_ where redeemers >= 6 order by offers_.ring_share desc, redeemers desc, entity, rel limit 200")
def offer_list(spark, sf_dir):
    """The offers page: by ring share, at least six redeemers, top 200."""
    x = _offers(spark, sf_dir).where("redeemers >= 6").orderBy(F.desc("ring_share"), F.desc("redeemers"), "entity", "rel").limit(200)
    return rounded(x.select("rel", "entity", "redeemers", "ring_share"))


@query(_ECONOMICS + " select ring_id, size, realised_fraud as fraud, round(value_at_stake + 1e-9, 6) as value_at_stake from eco_ where realised_fraud >= 1 order by eco_.value_at_stake desc, ring_id limit 100")
def review_queue(spark, sf_dir):
    """The review queue: rings with known fraud by money."""
    x = _economics(spark, sf_dir).where("realised_fraud >= 1").orderBy(F.desc("value_at_stake"), "ring_id").limit(100)
    return rounded(x.select("ring_id", "size", F.col("realised_fraud").alias("fraud"), "value_at_stake"))


def _half(o, half: str):
    """The orders of one half of the days."""
    return o.join(F.broadcast(graph.windows(o).where(F.col("half") == half).select("day_ordinal")), "day_ordinal", "left_semi")


def _peeled(spark, sf_dir, half=None, density: bool = False):
    """Rings of the pruned graph, of all orders or of one half of the days: its name, or its orders."""
    a, o = _accounts(spark, sf_dir), adapter.orders(spark, sf_dir) if half is None or isinstance(half, str) else half
    if isinstance(half, str):
        o = _half(o, half)
    live = a.where("score > 0.5").select("user_id", "score")
    return peel.extract_rings(graph.build_graph(o, among=live), live).select("ring_id", "user_id", *["density"] * density)


@query()
def hostel_test_peeled(spark, sf_dir):
    """How flagged hostels are by all peeled rings; a test holds the shares against brute force."""
    mem = graph.members(adapter.orders(spark, sf_dir))
    cl = rings.colocated_clusters(mem, _accounts(spark, sf_dir), "r1", least=8)
    return rounded(rings.hostel_test(cl, mem, "r1", edges(spark, sf_dir), _accounts(spark, sf_dir), _peeled(spark, sf_dir)))


def _halves(spark, sf_dir):
    """Peeled rings of the early and of the late days, found at the same time: a kernel is one task. Orders are joined once."""
    o = iterate.cut(adapter.orders(spark, sf_dir).drop("sku_id"))
    with ThreadPoolExecutor(2) as both:
        return list(both.map(lambda half: _peeled(spark, sf_dir, half), [_half(o, half) for half in ("early", "late")]))


@query()
def night_similarity(spark, sf_dir):
    """Rings of the early and of the late days that are alike; a test holds them against brute force."""
    return rounded(rings.ring_similarity(*_halves(spark, sf_dir), 0.3))


@query()
def night_cases(spark, sf_dir):
    """Which rings of the late days are cases of the early ones."""
    return rings.match_night(*_halves(spark, sf_dir), 0.3, 10_000_000)
