"""Queries: profiles, the account graph, features, fixpoints, bursts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringloom.operators import bursts, features, graph, iterate, stress
from ringloom.sources import adapter

from .common import BASE, EDGES, MEMBERS, edges, rounded
from .registry import query


@query(BASE + "select user_id, sku_id, day_ordinal, r1, r3, r6, r7, r8 from orders_")
def order_stream(spark, sf_dir):
    """The order stream itself."""
    return adapter.orders(spark, sf_dir)


@query(BASE + "select day_ordinal, count(*) as orders, count(distinct user_id) as accounts, min(user_id) as first_user, max(user_id) as last_user from orders_ group by 1")
def order_profile(spark, sf_dir):
    """Orders and accounts by day."""
    return adapter.orders(spark, sf_dir).groupBy("day_ordinal").agg(F.count("*").alias("orders"), F.count_distinct("user_id").alias("accounts"), F.min("user_id").alias("first_user"), F.max("user_id").alias("last_user"))


@query(BASE + "select label::bigint as label, count(*) as accounts, bool_and(score between 0 and 1) as scores_ok from accounts_ group by 1")
def node_profile(spark, sf_dir):
    """Accounts by label."""
    return rounded(adapter.accounts(spark, sf_dir).groupBy("label").agg(F.count("*").alias("accounts"), F.bool_and(F.col("score").between(0, 1)).alias("scores_ok")))


@query(EDGES + "select n_relations::bigint as n_relations, count(*) as edges, count(*) filter (where src = dst) as self_loops, count(distinct (least(src, dst), greatest(src, dst))) as pairs, round(min(weight::double) + 1e-9, 6) as lightest, round(max(weight::double) + 1e-9, 6) as heaviest from edges_ group by 1")
def edge_profile(spark, sf_dir):
    """Edges by the number of relations behind them."""
    e = edges(spark, sf_dir)
    return rounded(e.groupBy("n_relations").agg(F.count("*").alias("edges"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), F.count_distinct(F.least("src", "dst"), F.greatest("src", "dst")).alias("pairs"), F.min("weight").alias("lightest"), F.max("weight").alias("heaviest")))


@query(
    MEMBERS
    + """select rel, count(*) as entities, sum(size)::bigint as memberships, max(size) as largest, quantile_cont(size, 0.99) as p99, count(*) filter (where size = 1) as singletons,
    sum(case when size <= 100 then size * (size - 1) // 2 else 0 end)::bigint as pairs_100, sum(case when size <= 1000 then size * (size - 1) // 2 else 0 end)::bigint as pairs_1000 from sizes_ group by 1"""
)
def relation_profile(spark, sf_dir):
    """Entity sizes of each relation, and the pairs that caps would leave."""
    s = graph.entity_sizes(graph.members(adapter.orders(spark, sf_dir)))
    pairs = lambda cap: F.sum(F.when(F.col("size") <= cap, F.expr("size * (size - 1) div 2")).otherwise(0))
    return s.groupBy("rel").agg(F.count("*").alias("entities"), F.sum("size").alias("memberships"), F.max("size").alias("largest"), F.percentile("size", F.lit(0.99)).alias("p99"), F.count_if(F.col("size") == 1).alias("singletons"), pairs(100).alias("pairs_100"), pairs(1000).alias("pairs_1000"))


@query(MEMBERS + "select rel, entity, size from sizes_")
def entity_sizes(spark, sf_dir):
    """Accounts of each entity."""
    return graph.entity_sizes(graph.members(adapter.orders(spark, sf_dir)))


@query(EDGES + "select src, dst, round(weight::double + 1e-9, 6) as weight, n_relations::bigint as n_relations, relation_mask::bigint as relation_mask, min_entity_size from edges_")
def account_edges(spark, sf_dir):
    """The account graph: capped entity self-join, rarity weights, one row per pair."""
    return rounded(edges(spark, sf_dir))


@query(EDGES + "select node, count(*) as degree, round(sum(weight::double) + 1e-9, 6) as weighted_degree from ways_ group by 1")
def weighted_degrees(spark, sf_dir):
    """Degree and weighted degree of each account."""
    return rounded(graph.both_ways(edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"), F.sum(F.col("weight").cast("double")).alias("weighted_degree")))


@query(EDGES + "select e.src, e.dst, round(weight::double + 1e-9, 6) as weight from edges_ e join accounts_ a on a.user_id = e.src and a.score > 0.5 join accounts_ b on b.user_id = e.dst and b.score > 0.5")
def pruned_edges(spark, sf_dir):
    """Edges whose ends both score above tau."""
    return rounded(graph.prune(edges(spark, sf_dir), adapter.accounts(spark, sf_dir), 0.5).select("src", "dst", "weight"))


@query(EDGES + "select node as user_id, count(*) as degree, round(sum(weight::double) + 1e-9, 6) as weighted_degree from ways_ join accounts_ a on a.user_id = node and a.score > 0.5 join accounts_ b on b.user_id = nbr and b.score > 0.5 group by 1 order by sum(weight::double) desc, user_id limit 20")
def top_accounts(spark, sf_dir):
    """The flagship: pruned graph, top 20 accounts by weighted degree."""
    e = graph.prune(edges(spark, sf_dir), adapter.accounts(spark, sf_dir), 0.5)
    g = graph.both_ways(e).groupBy(F.col("node").alias("user_id")).agg(F.count("*").alias("degree"), F.sum(F.col("weight").cast("double")).alias("weighted_degree"))
    return rounded(g.orderBy(F.desc("weighted_degree"), "user_id").limit(20))


@query(BASE + ", d as (select distinct day_ordinal from orders_) select day_ordinal, case when row_number() over (order by day_ordinal) <= count(*) over () // 2 then 'early' else 'late' end as half from d")
def day_windows(spark, sf_dir):
    """Early and late half of the days present."""
    return graph.windows(adapter.orders(spark, sf_dir))


@query(
    EDGES.replace("from orders_ union", "from late_ union").replace("from orders_)", "from late_)").replace("long_ as (", "days_ as (select day_ordinal, row_number() over (order by day_ordinal) as k, count(*) over () as n from (select distinct day_ordinal from orders_)),\nlate_ as (select o.* from orders_ o join days_ using (day_ordinal) where k > n // 2),\nlong_ as (")
    + "select src, dst, round(weight::double + 1e-9, 6) as weight, relation_mask::bigint as relation_mask from edges_"
)
def late_edges(spark, sf_dir):
    """The graph of the late half."""
    o = adapter.orders(spark, sf_dir)
    late = graph.windows(o).where("half = 'late'").select("day_ordinal")
    return rounded(graph.build_graph(o.join(F.broadcast(late), "day_ordinal", "left_semi")).select("src", "dst", "weight", "relation_mask"))


@query(
    BASE
    + """, per as (select user_id, day_ordinal, count(*) as k from orders_ group by all),
days as (select user_id, count(*) as active_days, max(k) as top, min(day_ordinal) as lo, max(day_ordinal) as hi from per group by 1),
base as (select user_id, count(*) as n, count(distinct sku_id) as skus, count(r6) as promos, count(distinct r6) as d6, count(distinct r7) as d7, count(distinct r1) as d1, count(distinct r3) as d3, count(distinct r8) as d8 from orders_ group by 1)
select user_id, n as n_orders, skus as n_distinct_sku, round(1 - skus / n + 1e-9, 6) as sku_repeat_rate, promos as n_promo_orders, round(promos / n + 1e-9, 6) as promo_order_rate, d6 as n_distinct_promo, d7 as n_distinct_coupon, d1 as n_distinct_location, d3 as n_distinct_delivery, d8 as n_distinct_stimulation,
 active_days, top as max_orders_in_day, round(n / active_days + 1e-9, 6) as orders_per_active_day, round(top / n + 1e-9, 6) as day_concentration, hi - lo + 1 - active_days as longest_gap_days from base join days using (user_id)"""
)
def order_features(spark, sf_dir):
    """The 15 order features."""
    return rounded(features.order_features(adapter.orders(spark, sf_dir)))


@query(
    EDGES
    + """, one as (select node, count(*) as degree, sum(weight::double) as wd, avg(weight::double) as wm, max(weight::double) as wx, avg(n_relations) as rm, max(n_relations) as rx, min(min_entity_size) as es, avg((min_entity_size <= 10)::int) as rare from ways_ group by 1),
two as (select w.node, sum(o.degree)::bigint as s, avg(o.degree) as m, max(o.degree) as x from ways_ w join one o on o.node = w.nbr group by 1)
select user_id, coalesce(degree, 0) as degree, round(coalesce(wd, 0) + 1e-9, 6) as weighted_degree, round(coalesce(wm, 0) + 1e-9, 6) as mean_edge_weight, round(coalesce(wx, 0) + 1e-9, 6) as max_edge_weight, round(coalesce(rm, 0) + 1e-9, 6) as mean_relations_per_edge, coalesce(rx, 0)::bigint as max_relations_per_edge, coalesce(es, 0) as min_entity_size, round(coalesce(rare, 0) + 1e-9, 6) as rare_edge_fraction,
 coalesce(s, 0)::bigint as two_hop_size, round(coalesce(m, 0) + 1e-9, 6) as neighbour_degree_mean, coalesce(x, 0) as neighbour_degree_max from accounts_ left join (one join two using (node)) on node = user_id"""
)
def graph_features(spark, sf_dir):
    """Graph features, core numbers aside."""
    return rounded(features.graph_features(edges(spark, sf_dir), adapter.accounts(spark, sf_dir)))


@query(EDGES + "select user_id, " + ", ".join(f"coalesce(sum((relation_mask >> {i}) & 1), 0)::bigint as degree_{r}" for i, r in enumerate(("r1", "r3", "r6", "r7", "r8"))) + " from accounts_ left join ways_ on node = user_id group by 1")
def relation_degrees(spark, sf_dir):
    """Neighbours by relation."""
    return features.relation_degrees(edges(spark, sf_dir), adapter.accounts(spark, sf_dir))


@query(
    EDGES
    + """, per as (select user_id, day_ordinal, count(*) as k from orders_ group by all), days as (select user_id, count(*) as active_days, max(k) as top from per group by 1),
base as (select user_id, count(*) as n, count(distinct sku_id) as skus, count(r6) as promos from orders_ group by 1), b as (select * from base join days using (user_id)),
g as (select w.node as user_id, avg(coalesce(n, 0)) as om, avg(coalesce(n, 0) * coalesce(n, 0)) as oq, avg(coalesce(active_days, 0)) as dm, avg(coalesce(active_days, 0) * coalesce(active_days, 0)) as dq, avg(coalesce(promos / n, 0)) as pm, avg(coalesce(top / n, 0)) as cm from ways_ w left join b on b.user_id = w.nbr group by 1)
select a.user_id, round(coalesce(om, 0) + 1e-9, 6) as neighbour_orders_mean, round(coalesce(sqrt(greatest(oq - om * om, 0)), 0) + 1e-9, 6) as neighbour_orders_std, round(coalesce(dm, 0) + 1e-9, 6) as neighbour_active_days_mean, round(coalesce(sqrt(greatest(dq - dm * dm, 0)), 0) + 1e-9, 6) as neighbour_active_days_std, round(coalesce(pm, 0) + 1e-9, 6) as neighbour_promo_rate_mean, round(coalesce(cm, 0) + 1e-9, 6) as neighbour_day_concentration_mean, round(case when om > 0 then coalesce(b.n, 0) / greatest(om, 1e-9::double) else 0 end + 1e-9, 6) as orders_vs_neighbour_mean
from accounts_ a left join g on g.user_id = a.user_id left join b on b.user_id = a.user_id"""
)
def neighbour_features(spark, sf_dir):
    """How neighbours order."""
    o = adapter.orders(spark, sf_dir)
    return rounded(features.neighbour_features(graph.build_graph(o), features.order_features(o), adapter.accounts(spark, sf_dir)))


@query()
def account_features(spark, sf_dir):
    """The 39 features of all accounts; their families have SQL of their own."""
    o, e = adapter.orders(spark, sf_dir), iterate.cut(edges(spark, sf_dir))
    return features.build_features(o, e, iterate.core_numbers(e))


@query()
def core_numbers(spark, sf_dir):
    """k-core number of each account; a test holds it against peeling."""
    return iterate.core_numbers(edges(spark, sf_dir))


_RARE = EDGES.replace("edges_ as (", "all_edges_ as (").replace("ways_ as (", "edges_ as (select * from all_edges_ where min_entity_size = 2 and n_relations >= 1 and relation_mask & 2 = 2),\nways_ as (")


@query(
    _RARE
    + """, reach as (select user_id as node, user_id as low from accounts_ union select w.nbr, r.low from reach r join ways_ w on w.node = r.node where r.low < w.nbr)
select node as user_id, min(low) as component from reach group by 1"""
)
def delivery_components(spark, sf_dir):
    """Connected components over pairs that share a private delivery record, isolated accounts too."""
    e = edges(spark, sf_dir).where("min_entity_size = 2 and (relation_mask & 2) = 2")
    return iterate.components(e, adapter.accounts(spark, sf_dir))


@query(EDGES + ", seeds as (select user_id from accounts_ where label = 1), one as (select user_id from seeds union select nbr from ways_ join seeds on node = user_id) select user_id from one union select nbr from ways_ join one on node = user_id")
def two_hop_closure(spark, sf_dir):
    """Every account within two hops of the fraud accounts."""
    seeds = adapter.accounts(spark, sf_dir).where("label = 1").select("user_id")
    return graph.close_neighbourhood(seeds, edges(spark, sf_dir), 2)


@query()
def fraud_components(spark, sf_dir):
    """Connected fraud accounts, five or more; a test holds them against brute force."""
    return stress.fraud_components(adapter.accounts(spark, sf_dir), edges(spark, sf_dir))


@query()
def fragmented_components(spark, sf_dir):
    """Edges left when connected fraud accounts split into cells of five."""
    return rounded(stress.fragment(edges(spark, sf_dir), stress.cells(fraud_components(spark, sf_dir), 5)).select("src", "dst", "weight"))


_DEGREE = ", d_ as (select user_id, coalesce(sum(weight::double), 0) as d from accounts_ left join ways_ on node = user_id group by 1), s0 as (select user_id, d, phi as b, phi as t from d_ join (select user_id, case label when 1 then 0.01::double when 0 then -0.01::double else 0.0::double end as phi from accounts_) using (user_id))"
_STEPS = "".join(
    f", s{i + 1} as (select s.user_id, s.d, s.b + coalesce(x, 0) * (2 * 0.001 / (1 - 4e-6)) - (4e-6 / (1 - 4e-6)) * s.d * s.t as b, coalesce(x, 0) * (2 * 0.001 / (1 - 4e-6)) - (4e-6 / (1 - 4e-6)) * s.d * s.t as t from s{i} s left join (select node, sum(weight::double * n.t) as x from ways_ join s{i} n on n.user_id = nbr group by 1) on node = s.user_id)"
    for i in range(3)
)


@query(EDGES + _DEGREE + _STEPS + " select user_id, round(b + 0.5, 9) as belief from s3")
def propagated_beliefs(spark, sf_dir):
    """Three rounds of linearised belief propagation from the labels."""
    prior = adapter.accounts(spark, sf_dir).select("user_id", F.when(F.col("label") == 1, 0.01).when(F.col("label") == 0, -0.01).otherwise(0.0).alias("phi"))
    return rounded(iterate.propagate(edges(spark, sf_dir), prior, 0.001, rounds=3), 9)


@query()
def converged_beliefs(spark, sf_dir):
    """Belief propagation from the labels until terms fall below 1e-6."""
    prior = adapter.accounts(spark, sf_dir).select("user_id", F.when(F.col("label") == 1, 0.01).when(F.col("label") == 0, -0.01).otherwise(0.0).alias("phi"))
    return iterate.propagate(edges(spark, sf_dir), prior, 0.001)


@query(MEMBERS + "select rel, count(*) as incidences, round(sum(1 / ln(2.0::double + size)) + 1e-9, 6) as weight from capped_ where rel in ('r6', 'r7', 'r8') group by 1")
def bipartite_incidence(spark, sf_dir):
    """Account-entity edges of the offer relations."""
    b = iterate.bipartite(graph.capped(graph.members(adapter.orders(spark, sf_dir), ("r6", "r7", "r8"))))
    return rounded(b.groupBy("rel").agg(F.count("*").alias("incidences"), F.sum("weight").alias("weight")))


_VISITS = BASE + ", v as (select sku_id as entity, user_id, min(r1 % 1000) as bin from orders_ group by 1, 2), z as (select entity, count(*) as size from v group by 1 having count(*) between 2 and 100), f as (select * from v join z using (entity))"
_EVENTS = "with v as (select event_type || '|' || json_extract_string(props, '$.k') as entity, user_id, min(epoch(ts)::bigint // {0}) as bin from events group by 1, 2), z as (select entity, count(*) as size from v group by 1 having count(*) between 2 and 100), f as (select * from v join z using (entity))"
_BURST = ", n as (select entity, size, bin, count(*) as n from f group by all), t as (select *, sum(n) over (partition by entity order by bin range between current row and 1 following) as two from n) select entity, size, round(max(n) / size + 1e-9, 6) as burst1, round(max(two) / size + 1e-9, 6) as burst2 from t group by entity, size"


def _arrivals(spark, sf_dir):
    o = adapter.orders(spark, sf_dir)
    return bursts.first_arrivals(o.select(F.col("sku_id").alias("entity"), "user_id", (F.col("r1") % 1000).alias("bin")))


def _event_arrivals(spark, sf_dir, width: int):
    return bursts.first_arrivals(adapter.events(spark, sf_dir).select("entity", "user_id", F.expr(f"seconds div {width}").alias("bin")))


@query(_VISITS + ", g as (select unnest(range(0, 100)) as bin), n as (select bin, count(*) as n from f group by 1) select bin::bigint as bin, round(case when sum(coalesce(n, 0)) over () > 0 then coalesce(n, 0) / sum(coalesce(n, 0)) over () else 0.01 end + 1e-9, 6) as share from g left join n using (bin)")
def arrival_shares(spark, sf_dir):
    """Share of first arrivals by month."""
    return rounded(bursts.daily_share(_arrivals(spark, sf_dir), 0, 99))


@query(_VISITS + " select entity, user_id, bin, size from f")
def first_arrivals(spark, sf_dir):
    """First arrival of each account at each entity."""
    return _arrivals(spark, sf_dir)


@query(_VISITS + _BURST)
def order_bursts(spark, sf_dir):
    """Burst statistics of orders by month."""
    return rounded(bursts.bursts(_arrivals(spark, sf_dir)))


@query(_EVENTS.format(3600) + _BURST)
def event_bursts_1h(spark, sf_dir):
    """Burst statistics of events by hour."""
    return rounded(bursts.bursts(_event_arrivals(spark, sf_dir, 3600)))


@query(_EVENTS.format(21600) + _BURST)
def event_bursts_6h(spark, sf_dir):
    """Burst statistics of events by six hours."""
    return rounded(bursts.bursts(_event_arrivals(spark, sf_dir, 21600)))


@query(_EVENTS.format(86400) + _BURST)
def event_bursts_1d(spark, sf_dir):
    """Burst statistics of events by day."""
    return rounded(bursts.bursts(_event_arrivals(spark, sf_dir, 86400)))


@query()
def burst_z_table(spark, sf_dir):
    """Bursts against a null model of independent arrivals, per exact size."""
    a = _arrivals(spark, sf_dir)
    null = bursts.null_by_size(bursts.daily_share(a, 0, 99), a.select("size"), draws=400)
    return bursts.burst_z(bursts.bursts(a), null)


@query(_VISITS + _BURST.replace(" select entity, size, round", ", b as (select entity, size, round").rstrip() + "), c as (select quantile_cont(burst2, [0.25, 0.5, 0.75]) as q from b) select entity, size, burst2, ((burst2 >= q[1])::int + (burst2 >= q[2])::int + (burst2 >= q[3])::int)::bigint as bin, case when size between 2 and 3 then 0 when size between 4 and 5 then 1 when size between 6 and 10 then 2 when size between 11 and 20 then 3 when size between 21 and 50 then 4 when size between 51 and 100 then 5 else -1 end::bigint as bucket from b, c")
def burst_quartiles(spark, sf_dir):
    """Quartile bins of bursts, and size buckets."""
    b = rounded(bursts.bursts(_arrivals(spark, sf_dir))).select("entity", "size", "burst2")
    return rounded(bursts.quartile_bins(b, "burst2").withColumn("bucket", bursts.size_bucket(F.col("size"))))


@query(
    EDGES
    + """, comp as (select user_id, user_id % 40 as component from accounts_ where label = 1), r as (select *, row_number() over (partition by component order by md5('20260902:' || user_id::varchar), user_id) as r, count(*) over (partition by component) as n from comp),
c as (select user_id, component, (r - 1) % ceil(n / 5)::bigint as cell from r)
select src, dst, round(weight::double + 1e-9, 6) as weight from edges_ left join c a on a.user_id = src left join c b on b.user_id = dst where a.component is null or b.component is null or (a.component = b.component and a.cell = b.cell)"""
)
def fragmented_edges(spark, sf_dir):
    """Edges left when fraud groups split into cells of five."""
    comp = adapter.accounts(spark, sf_dir).where("label = 1").select("user_id", (F.col("user_id") % 40).alias("component"))
    return rounded(stress.fragment(edges(spark, sf_dir), stress.cells(comp, 5)).select("src", "dst", "weight"))


@query(
    EDGES
    + """, top as (select max(user_id) + 1 as n from accounts_), old as (select user_id, row_number() over (order by user_id) - 1 as k from accounts_ where label = 1 and score <= 0.5), clone as (select user_id, n + k as new_id from old, top),
w as (select new_id, nbr, node, weight from ways_ join clone on node = user_id)
select src, dst, round(weight::double + 1e-9, 6) as weight from edges_ union all select least(new_id, nbr), greatest(new_id, nbr), round(weight::double + 1e-9, 6) from w
union all select user_id, new_id, round(coalesce(m, 0.5)::float::double + 1e-9, 6) from clone left join (select node, quantile_cont(weight::double, 0.5) as m from w group by 1) on node = user_id"""
)
def duplicated_edges(spark, sf_dir):
    """The graph with a clone of each undetected fraud account."""
    a = adapter.accounts(spark, sf_dir)
    e, _ = stress.duplicate(edges(spark, sf_dir), a, a.where("label = 1 and score <= 0.5").select("user_id"))
    return rounded(e.select("src", "dst", "weight"))


@query()
def mutual_nearest(spark, sf_dir):
    """Mutual nearest neighbours of the embeddings; a test holds them against brute force."""
    e = adapter.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return stress.mutual_knn(e)


@query()
def instrument_overlay(spark, sf_dir):
    """Edges of a simulated shared instrument."""
    return stress.instrument_edges(fraud_components(spark, sf_dir), adapter.accounts(spark, sf_dir), 0.8, 0.1)


@query()
def neighbour_sample(spark, sf_dir):
    """Two-hop neighbour sample of the labelled fraud accounts."""
    return stress.sample_neighbours(edges(spark, sf_dir), adapter.accounts(spark, sf_dir).where("label = 1").select("user_id"), (15, 10))


@query(
    EDGES
    + """, w as (select node, nbr, weight from ways_ join accounts_ a on a.user_id = node and a.score > 0.5 join accounts_ b on b.user_id = nbr and b.score > 0.5),
anchor as (select user_id as anchor from accounts_ where score > 0.5 order by score desc, user_id limit 500),
one as (select anchor, nbr as user_id, weight from anchor join w on node = anchor), two as (select o.anchor, w.nbr as user_id, w.weight from one o join w on w.node = o.user_id),
every as (select anchor, anchor as user_id, 0 as hop, 0.0::double as lost from anchor union all select anchor, user_id, 1, -weight::double from one union all select anchor, user_id, 2, -weight::double from two),
best as (select anchor, user_id, min((hop, lost)) as b from every group by all)
select * from (select anchor, user_id, b[1]::bigint as hop, row_number() over (partition by anchor order by b, user_id) as place from best) where place <= 3000"""
)
def anchor_balls(spark, sf_dir):
    """The two-hop ball of each of the top 500 anchors inside the suspicious accounts."""
    a = adapter.accounts(spark, sf_dir).where("score > 0.5")
    anchors = a.orderBy(F.desc("score"), "user_id").limit(500).select(F.col("user_id").alias("anchor"))
    return rounded(graph.ball(edges(spark, sf_dir), anchors, a.select("user_id")))


@query(EDGES + ", c as (select user_id, label, score, row_number() over (order by score desc, user_id) as k from accounts_) select c.user_id, round(score + 1e-9, 6) as score, case label when 1 then 'fraud' when 0 then 'normal' else 'unknown' end as label, count(node) as neighbours, count(*) filter (where min_entity_size <= 10 and node is not null) as rare_links from c left join ways_ on node = c.user_id group by all")
def account_cards(spark, sf_dir):
    """What a lookup of an account shows."""
    w = graph.both_ways(edges(spark, sf_dir)).groupBy(F.col("node").alias("user_id")).agg(F.count("*").alias("neighbours"), F.count_if(F.col("min_entity_size") <= 10).alias("rare_links"))
    a = adapter.accounts(spark, sf_dir)
    text = F.when(F.col("label") == 1, "fraud").when(F.col("label") == 0, "normal").otherwise("unknown")
    return rounded(a.join(w, "user_id", "left").fillna(0, ["neighbours", "rare_links"]).select("user_id", "score", text.alias("label"), "neighbours", "rare_links"))


