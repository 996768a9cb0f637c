"""What rings are worth and what they share: evaluation, evidence, hostels, offers, tracking."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.config import RELATIONS, SETTINGS

from .graph import inner_edges, long_form, ring_totals
from .iterate import cut


def label_counts(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """ring_id, size, fraud, normal, unknown, precision (labelled members only, null if none)."""
    x = members.select("ring_id", "user_id").distinct().join(nodes.select("user_id", "label"), "user_id", "left")
    c = x.groupBy("ring_id").agg(F.count("*").alias("size"), F.count_if(F.col("label") == 1).alias("fraud"), F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.coalesce("label", F.lit(-1)) < 0).alias("unknown"))
    return c.withColumn("precision", F.when(F.col("fraud") + F.col("normal") > 0, F.col("fraud") / (F.col("fraud") + F.col("normal"))))


def evaluate(members: DataFrame, nodes: DataFrame, value: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """One row over the distinct members of all rings: accounts, fraud, normal, unknown, precision,
    recall over all labelled fraud, normal_per_fraud, fp_cost (value(user_id, value) of normal
    members), and sizes. only(user_id) restricts labels, e.g. to held-out accounts."""
    known = nodes.select("user_id", "label")
    if only is not None:
        known = known.join(only.select("user_id"), "user_id", "left_semi")
    m = members.select("user_id").distinct().join(known, "user_id", "left").join(value, "user_id", "left")
    one = m.agg(F.count("*").alias("accounts"), F.count_if(F.col("label") == 1).alias("fraud"), F.count_if(F.col("label") == 0).alias("normal"), F.count_if(F.coalesce("label", F.lit(-1)) < 0).alias("unknown"), F.sum(F.when(F.col("label") == 0, F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias("fp_cost"))
    size = members.groupBy("ring_id").agg(F.count_distinct("user_id").alias("n")).agg(F.count("*").alias("rings"), F.min("n").alias("size_min"), F.percentile("n", F.lit(0.5)).alias("size_median"), F.max("n").alias("size_max"))
    every = known.agg(F.count_if(F.col("label") == 1).alias("f"))
    x = one.crossJoin(size).crossJoin(every)  # single rows
    safe = lambda n, d: F.when(d > 0, n / d)
    return x.select("rings", "accounts", "fraud", "normal", "unknown", safe(F.col("fraud"), F.col("fraud") + F.col("normal")).alias("precision"), safe(F.col("fraud"), F.col("f")).alias("recall"), safe(F.col("normal"), F.col("fraud")).alias("normal_per_fraud"), "fp_cost", "size_min", "size_median", "size_max", ((F.col("fraud") + F.col("normal")) < 30).alias("small_sample"))


def colocated_clusters(mem: DataFrame, nodes: DataFrame, relation: str, least: int = 15, n_max: int = SETTINGS.n_max, labelled: int = 3, share: float = 0.8) -> DataFrame:
    """entity, size, labelled, normal_share: groups that share an entity and are mostly normal."""
    x = mem.where(F.col("rel") == relation).join(nodes.select("user_id", "label"), "user_id", "left")
    c = x.groupBy("entity").agg(F.count("*").alias("size"), F.count_if(F.col("label") >= 0).alias("labelled"), F.count_if(F.col("label") == 0).alias("normal"))
    return c.where(F.col("size").between(least, n_max) & (F.col("labelled") >= labelled)).withColumn("normal_share", F.col("normal") / F.col("labelled")).where(F.col("normal_share") >= share)


def hostel_test(clusters: DataFrame, mem: DataFrame, relation: str, edges: DataFrame, scores: DataFrame, ring_members: DataFrame) -> DataFrame:
    """Per cluster: share_in_ring, mean and max score, edges inside, relation_diversity (bits set over
    all of them). An account of several clusters belongs to the one of the largest entity id."""
    last = mem.where(F.col("rel") == relation).join(clusters.select("entity"), "entity").groupBy("user_id").agg(F.max("entity").alias("entity"))
    ring = ring_members.select("user_id").distinct().withColumn("in_ring", F.lit(1.0))
    who = mem.where(F.col("rel") == relation).join(clusters.select("entity"), "entity").join(scores.select("user_id", "score"), "user_id", "left").join(ring, "user_id", "left")
    per = who.groupBy("entity").agg(F.avg(F.coalesce("in_ring", F.lit(0.0))).alias("share_in_ring"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean_score"), F.max(F.coalesce("score", F.lit(0.0))).alias("max_score"))
    inner = edges.join(last.select(F.col("user_id").alias("src"), "entity"), "src").join(last.select(F.col("user_id").alias("dst"), "entity"), ["dst", "entity"])
    e = inner.groupBy("entity").agg(F.count("*").alias("internal_edges"), F.bit_count(F.bit_or(F.col("relation_mask").cast("long"))).alias("relation_diversity"))
    return clusters.join(per, "entity").join(e, "entity", "left").fillna(0, ["internal_edges", "relation_diversity"])


def evidence(ring_members: DataFrame, orders: DataFrame, least: float = 0.15, platform: float = 0.05, top: int = 12) -> DataFrame:
    """ring_id, rel, entity, users, coverage, global_users, rarity, place: entities that a share of the
    members has and few others do. An entity of more than a share of the platform (all ids up to the
    largest) explains nothing. In order of coverage times rarity (both to four places), then relation and
    entity, at most `top` a ring."""
    # an account's entities in one row, with their sizes. Those that it alone has have one place in a ring
    # but for relation and entity, so the first `top` of them are enough
    long = long_form(orders).select("bit", "entity", "user_id").repartition("bit", "entity").distinct().withColumn("size", F.count("*").over(Window.partitionBy("bit", "entity")))
    ids = (orders.agg(F.max("user_id")).first()[0] or 0) + 1
    has = F.struct("bit", "entity", "size")
    own = long.where(F.col("size") <= platform * ids).groupBy("user_id").agg(F.collect_list(F.when(F.col("size") > 1, has)).alias("shared"), F.slice(F.array_sort(F.collect_list(F.when(F.col("size") == 1, has))), 1, top).alias("alone"))
    own = cut(own.select("user_id", F.concat("shared", "alone").alias("has")))
    m = ring_members.select("ring_id", "user_id").distinct()
    m = cut(m.join(m.groupBy("ring_id").agg(F.count("*").alias("n")), "ring_id"))
    # the members' entities are laid beside each other for so many rings at a time that they are twice all accounts' entities
    held = own.select("user_id", F.size("has").alias("k"))
    all_, laid = held.agg(F.sum("k")).first()[0] or 0, m.join(held, "user_id").agg(F.sum("k")).first()[0] or 0
    times = max(1, math.ceil(laid / (2 * all_))) if all_ else 1
    place = F.row_number().over(Window.partitionBy("ring_id").orderBy(F.desc(F.round(F.col("coverage") * F.col("rarity"), 9)), "bit", "entity"))
    done = None
    for i in range(times):
        some = m.where(F.pmod(F.xxhash64("ring_id"), F.lit(times)) == i) if times > 1 else m
        x = some.join(own, "user_id").select("ring_id", "n", F.filter("has", lambda e: e["size"] / F.col("n") >= least).alias("has")).repartition("ring_id")
        got = x.select("ring_id", "n", F.inline("has")).groupBy("ring_id", "n", "bit", "entity", "size").agg(F.count("*").alias("users"))
        got = got.withColumn("coverage", F.col("users") / F.col("n")).where(F.col("coverage") >= least)
        got = got.withColumn("coverage", F.bround("coverage", 4)).withColumn("rarity", F.bround(1 / F.log(SETTINGS.rarity_base + F.col("size")), 4))
        rel = F.element_at(F.array(*map(F.lit, RELATIONS)), F.col("bit") + 1)
        got = cut(got.withColumn("place", place).where(F.col("place") <= top).select("ring_id", rel.alias("rel"), "entity", "users", "coverage", F.col("size").alias("global_users"), "rarity", "place"))
        done = got if done is None else done.unionByName(got)
    return done


def ring_orders(ring_members: DataFrame, orders: DataFrame, subsidy: float = SETTINGS.subsidy_per_promo, value: float = SETTINGS.value_per_order) -> DataFrame:
    """ring_id, n_orders, n_promo_orders, top_day_share, subsidy, order_value."""
    x = ring_members.select("ring_id", "user_id").distinct().join(orders.select("user_id", "day_ordinal", "r6"), "user_id")
    d = x.groupBy("ring_id", "day_ordinal").agg(F.count("*").alias("k"), F.count("r6").alias("p"))
    r = d.groupBy("ring_id").agg(F.sum("k").alias("n_orders"), F.sum("p").alias("n_promo_orders"), F.max("k").alias("top"))
    return r.select("ring_id", "n_orders", "n_promo_orders", (F.col("top") / F.col("n_orders")).alias("top_day_share"), (F.col("n_promo_orders") * F.lit(subsidy)).alias("subsidy"), (F.col("n_orders") * F.lit(value)).alias("order_value"))


def promo_by_day(ring_members: DataFrame, orders: DataFrame, lo: int, hi: int) -> DataFrame:
    """ring_id, day_ordinal, promo_orders, with zeros for the other days of lo..hi."""
    m = ring_members.select("ring_id", "user_id").distinct()
    x = m.join(orders.where(F.col("r6").isNotNull() & F.col("day_ordinal").between(lo, hi)).select("user_id", "day_ordinal"), "user_id").groupBy("ring_id", "day_ordinal").agg(F.count("*").alias("promo_orders"))
    grid = m.select("ring_id").distinct().withColumn("day_ordinal", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"))))
    return grid.join(x, ["ring_id", "day_ordinal"], "left").fillna(0, ["promo_orders"])


#: Names and order of the ring features are a fixed interface.
RING_FEATURES = ("size", "density", "internal_weight_per_member", "score_mass_per_member", "relation_kinds", "top_entity_coverage", "top_entity_platform_count", "top_entity_rarity", "rare_edge_share", "score_mean", "score_median", "score_min", "score_p10", "score_std", "orders_per_member", "promo_share", "busiest_day_share", "day_span", "active_days_per_member", "tau", "lambda")


def ring_days(members: DataFrame, orders: DataFrame) -> DataFrame:
    """ring_id, orders, promo, top (orders of the busiest day), lo, hi, days of members(ring_id, user_id), distinct, with orders.
    Rings share accounts: an account's days are counted first, and laid beside members for so many rings at a time
    that they are five times all accounts' days."""
    per = orders.groupBy("user_id", "day_ordinal").agg(F.count("*").alias("k"), F.count("r6").alias("p"))
    per = cut(per.groupBy("user_id").agg(F.collect_list(F.struct("day_ordinal", "k", "p")).alias("days")))
    held = per.select("user_id", F.size("days").alias("n"))
    all_, laid = held.agg(F.sum("n")).first()[0] or 0, members.join(held, "user_id").agg(F.sum("n")).first()[0] or 0
    times, done = max(1, math.ceil(laid / (5 * all_))) if all_ else 1, None
    for i in range(times):
        some = members.where(F.pmod(F.xxhash64("ring_id"), F.lit(times)) == i) if times > 1 else members
        day = some.join(per, "user_id").select("ring_id", F.inline("days")).groupBy("ring_id", "day_ordinal").agg(F.sum("k").alias("k"), F.sum("p").alias("p"))
        got = cut(day.groupBy("ring_id").agg(F.sum("k").alias("orders"), F.sum("p").alias("promo"), F.max("k").alias("top"), F.min("day_ordinal").alias("lo"), F.max("day_ordinal").alias("hi"), F.count("*").alias("days")))
        done = got if done is None else done.unionByName(got)
    return done


def ring_features(ring_members: DataFrame, edges: DataFrame | None, scores: DataFrame, orders: DataFrame, tau: float = SETTINGS.tau, lambda_: float = SETTINGS.lambda_, rare: int = SETTINGS.rare_entity, tails: DataFrame | None = None) -> DataFrame:
    """ring_id and the 21 label-free features of each ring, for rings found with tau and lambda_. An
    account without a score has 0. tails: account_tails in place of the edges. Each part is written before the next is made."""
    m = cut(ring_members.select("ring_id", "user_id").distinct())
    x = m.join(scores.select("user_id", "score"), "user_id", "left").fillna(0.0, ["score"])
    s = cut(x.groupBy("ring_id").agg(
        F.count("*").alias("size"), F.sum("score").alias("mass"), F.avg("score").alias("score_mean"), F.percentile("score", F.lit(0.5)).alias("score_median"), F.min("score").alias("score_min"), F.percentile("score", F.lit(0.1)).alias("score_p10"), F.stddev_pop("score").alias("score_std"),
    ))
    if tails is not None:
        e = ring_totals(tails, m, rare)
    else:
        e = inner_edges(edges, m).groupBy("ring_id").agg(
            F.count("*").alias("pairs"), F.sum(F.col("weight").cast("double")).alias("weight"), F.bit_count(F.bit_or(F.col("relation_mask").cast("long"))).alias("relation_kinds"), F.min("min_entity_size").alias("top_entity_platform_count"), F.avg((F.col("min_entity_size") <= rare).cast("double")).alias("rare_edge_share")
        )
    y = s.join(cut(e), "ring_id", "left").join(ring_days(m, orders), "ring_id", "left").withColumn("day_span", F.coalesce(F.col("hi") - F.col("lo") + 1, F.lit(0))).fillna(0)
    n, count = F.col("size"), F.col("top_entity_platform_count")
    named = {
        "density": (F.col("weight") + lambda_ * F.col("mass")) / n,
        "internal_weight_per_member": F.col("weight") / n,
        "score_mass_per_member": F.col("mass") / n,
        "top_entity_coverage": F.col("pairs") / F.greatest(n * (n - 1) / 2, F.lit(1)),
        "top_entity_rarity": F.when(count > 0, 1 / F.log(2.0 + count)).otherwise(0.0),
        "orders_per_member": F.col("orders") / n,
        "promo_share": F.col("promo") / F.greatest(F.col("orders"), F.lit(1)),
        "busiest_day_share": F.when(F.col("orders") > 0, F.col("top") / F.col("orders")).otherwise(0.0),
        "active_days_per_member": F.col("days") / n,
        "tau": F.lit(float(tau)),
        "lambda": F.lit(float(lambda_)),
    }
    return y.select("ring_id", *(named.get(c, F.col(c)).cast("double").alias(c) for c in RING_FEATURES))


def ring_similarity(left: DataFrame, right: DataFrame, theta: float) -> DataFrame:
    """a, b, shared, jaccard of rings (ring_id, user_id) with Jaccard >= theta. Pairs without a
    common member are never made."""
    x, y = left.select(F.col("ring_id").alias("a"), "user_id").distinct(), right.select(F.col("ring_id").alias("b"), "user_id").distinct()
    k = x.join(y, "user_id").groupBy("a", "b").agg(F.count("*").alias("shared"))
    n, m = x.groupBy("a").agg(F.count("*").alias("n")), y.groupBy("b").agg(F.count("*").alias("m"))
    j = k.join(n, "a").join(m, "b").withColumn("jaccard", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")))
    return j.where(F.col("jaccard") >= theta).select("a", "b", "shared", "jaccard")


def match_night(fronts: DataFrame, rings: DataFrame, theta: float, next_id: int) -> DataFrame:
    """case_id, ring_id, event for one night. fronts(ring_id = case id, user_id) are last night's
    cases, rings(ring_id, user_id) tonight's. A ring continues the case of its best match if it is also
    the case's best; other matches are splits; a ring that two cases or more match is merged, and they
    merge into it; cases without a match died; new rings get ids from next_id on, in ring order."""
    sim = ring_similarity(fronts, rings, theta)
    pred = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("jaccard"), "a"))
    succ = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("jaccard"), "b"))
    s = sim.withColumn("pred", pred).withColumn("succ", succ).withColumn("many", F.count("*").over(Window.partitionBy("b")))
    best = s.where("pred = 1").select(F.col("b").alias("ring_id"), "a", "succ", "many")
    all_ = rings.select("ring_id").distinct().join(best, "ring_id", "left")
    kind = F.when(F.col("a").isNull(), "born").when(F.col("succ") > 1, "split").when(F.col("many") > 1, "merged").otherwise("continued")
    ev = all_.withColumn("event", kind).withColumn("fresh", F.col("event").isin("born", "split"))
    number = F.sum(F.col("fresh").cast("long")).over(Window.orderBy("ring_id").rowsBetween(Window.unboundedPreceding, 0))
    now = ev.withColumn("k", number).select(F.when(F.col("fresh"), next_id + F.col("k") - 1).otherwise(F.col("a")).cast("long").alias("case_id"), F.col("ring_id").cast("long").alias("ring_id"), "event")
    kept = now.where("event in ('continued', 'merged')").select("case_id")
    first = s.where("succ = 1").select(F.col("a").alias("case_id"), F.col("b").alias("ring_id"))
    gone = fronts.select(F.col("ring_id").alias("case_id")).distinct().join(kept, "case_id", "left_anti").join(first, "case_id", "left")
    gone = gone.select(F.col("case_id").cast("long").alias("case_id"), F.col("ring_id").cast("long").alias("ring_id"), F.when(F.col("ring_id").isNull(), "died").otherwise("merged_into").alias("event"))
    return now.unionByName(gone)


def coverage_curve(ranked: DataFrame, most: int = 50) -> DataFrame:
    """ranked(rank, user_id) -> rank, covered: accounts of the offers up to each rank."""
    x = ranked.where(F.col("rank") <= most).groupBy("user_id").agg(F.min("rank").alias("rank"))
    n = x.groupBy("rank").agg(F.count("*").alias("n"))
    every = ranked.where(F.col("rank") <= most).select("rank").distinct().join(n, "rank", "left").fillna(0)
    return every.select("rank", F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)).alias("covered"))


def precision_at_depth(ranked: DataFrame, nodes: DataFrame, depths: tuple[int, ...] = (25, 100, 200)) -> DataFrame:
    """depth, accounts, labelled, fraud, precision; an account counts at its first ring."""
    x = ranked.groupBy("user_id").agg(F.min("rank").alias("rank")).join(nodes.select("user_id", "label"), "user_id", "left")
    x = x.withColumn("depth", F.explode(F.array(*(F.lit(d) for d in depths)))).where("rank <= depth")
    c = x.groupBy("depth").agg(F.count("*").alias("accounts"), F.count_if(F.col("label") >= 0).alias("labelled"), F.count_if(F.col("label") == 1).alias("fraud"))
    return c.withColumn("precision", F.when(F.col("labelled") > 0, F.col("fraud") / F.col("labelled")))


def precision_at_budget(ranked: DataFrame, nodes: DataFrame, budgets: tuple[int, ...] = (250, 500, 1000, 2000)) -> DataFrame:
    """budget, labelled, fraud, precision over the first accounts in ring order, then by id."""
    first = ranked.groupBy("user_id").agg(F.min("rank").alias("rank"))
    top = first.orderBy("rank", "user_id").limit(max(budgets)).join(nodes.select("user_id", "label"), "user_id", "left")
    x = top.withColumn("r", F.row_number().over(Window.orderBy("rank", "user_id"))).withColumn("budget", F.explode(F.array(*(F.lit(b) for b in budgets)))).where("r <= budget")
    c = x.groupBy("budget").agg(F.count_if(F.col("label") >= 0).alias("labelled"), F.count_if(F.col("label") == 1).alias("fraud"))
    return c.withColumn("precision", F.when(F.col("labelled") > 0, F.col("fraud") / F.col("labelled")))


def offers(orders: DataFrame, scores: DataFrame, nodes: DataFrame, ring_of: DataFrame, relations: tuple[str, ...] = ("r6", "r7", "r8"), floor: int = 5, ceiling: float = 0.1) -> DataFrame:
    """One row per offer (rel, entity) that floor accounts or more, and at most a share of all active
    ones, redeemed: redeemers, in_ring, rings, ring_share and mean_score (the two label-free rankings),
    p90_score, stake, labelled, fraud, fraud_share. ring_of(user_id, ring_id) may have several
    rings of an account."""
    x = _redeemers(orders, relations)
    most = orders.agg(F.floor(ceiling * F.count_distinct("user_id")).alias("most"))  # a single row
    ok = x.groupBy("rel", "entity").agg(F.count("*").alias("redeemers")).crossJoin(F.broadcast(most)).where((F.col("redeemers") >= floor) & (F.col("redeemers") <= F.col("most"))).drop("most")
    rings_ = ring_of.select("user_id", "ring_id").distinct()
    who = x.join(ok.select("rel", "entity"), ["rel", "entity"]).join(scores.select("user_id", F.coalesce("score", F.lit(0.0)).alias("score")), "user_id", "left").join(nodes.select("user_id", "label"), "user_id", "left").join(rings_.select("user_id").distinct().withColumn("inside", F.lit(1)), "user_id", "left")
    g = who.groupBy("rel", "entity").agg(
        F.count("inside").alias("in_ring"), F.round(F.avg(F.coalesce("score", F.lit(0.0))) + 1e-9, 6).alias("mean_score"), F.round(F.percentile(F.coalesce("score", F.lit(0.0)), F.lit(0.9)) + 1e-9, 6).alias("p90_score"),
        F.count_if(F.col("label") >= 0).alias("labelled"), F.count_if(F.col("label") == 1).alias("fraud"),
    )
    several = x.join(ok.select("rel", "entity"), ["rel", "entity"]).join(rings_, "user_id").groupBy("rel", "entity").agg(F.count_distinct("ring_id").alias("rings"))
    y = ok.join(g, ["rel", "entity"]).join(several, ["rel", "entity"], "left").fillna(0, ["rings"])
    y = y.withColumn("ring_share", F.bround(F.col("in_ring") / F.col("redeemers"), 6)).withColumn("stake", F.col("redeemers") * SETTINGS.subsidy_per_promo)
    return y.withColumn("fraud_share", F.when(F.col("labelled") > 0, F.bround(F.col("fraud") / F.col("labelled"), 4)))


def _redeemers(orders: DataFrame, relations: tuple[str, ...]) -> DataFrame:
    return long_form(orders, relations).select("rel", "entity", "user_id").distinct()


def offer_exclusions(orders: DataFrame, relations: tuple[str, ...] = ("r6", "r7", "r8"), floor: int = 5, ceiling: float = 0.1) -> DataFrame:
    """rel, too_small, platform_default: entities that are no offers, by why."""
    most = orders.agg(F.floor(ceiling * F.count_distinct("user_id")).alias("most"))  # a single row
    n = _redeemers(orders, relations).groupBy("rel", "entity").agg(F.count("*").alias("n")).crossJoin(F.broadcast(most))
    return n.groupBy("rel").agg(F.count_if(F.col("n") < floor).alias("too_small"), F.count_if((F.col("n") >= floor) & (F.col("n") > F.col("most"))).alias("platform_default"))


def rank_offers(table: DataFrame, top: int, by: str = "ring_share") -> DataFrame:
    """The top offers by ring_share or mean_score, then redeemers, entity and relation: with rank."""
    key = (F.desc(by), F.desc("redeemers"), "entity", "rel")
    return table.orderBy(*key).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*key)))


def random_precision(table: DataFrame, redeemers: DataFrame, nodes: DataFrame, depths: tuple[int, ...] = (10, 25, 50), draws: int = 200, seed: int = SETTINGS.seed) -> DataFrame:
    """depth, draws, mean, least, most: pooled precision of as many offers drawn at random, `draws`
    times. table(rel, entity) are the offers, redeemers(rel, entity, user_id) their accounts. A
    draw takes the smallest md5 of seed, draw and offer; a depth with no more offers than it has none."""
    d = table.select("rel", "entity").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("rel"), F.col("entity").cast("string")))
    place = F.row_number().over(Window.partitionBy("draw").orderBy("h", "rel", "entity"))
    drawn = d.withColumn("h", key).withColumn("rank", place).where(F.col("rank") <= max(depths)).select("draw", "rel", "entity", "rank")
    first = drawn.join(redeemers, ["rel", "entity"]).groupBy("draw", "user_id").agg(F.min("rank").alias("rank")).join(nodes.where("label >= 0").select("user_id", "label"), "user_id")
    at = first.withColumn("depth", F.explode(F.array(*(F.lit(k) for k in depths)))).where("rank <= depth")
    p = at.groupBy("depth", "draw").agg(F.avg("label").alias("precision"))
    enough = table.agg(F.count("*").alias("offers"))  # a single row
    p = p.crossJoin(F.broadcast(enough)).where("offers > depth")
    return p.groupBy("depth").agg(F.count("*").alias("draws"), F.avg("precision").alias("mean"), F.min("precision").alias("least"), F.max("precision").alias("most"))


def labels_for(entities: DataFrame) -> DataFrame:
    """Short stable names for entities(rel, entity, first_seen): numbered per relation by first
    appearance, e.g. r6-0001."""
    k = F.row_number().over(Window.partitionBy("rel").orderBy("first_seen", "entity"))
    return entities.select("rel", "entity", F.concat("rel", F.lit("-"), F.lpad(k.cast("string"), 4, "0")).alias("name"))


def blend(scored: DataFrame) -> DataFrame:
    """score with a context share, context over its maximum c: boosted = score * (1 + c),
    tie_break = score + 1e-6 c."""
    top = scored.agg(F.max("context").alias("top"))  # a single row
    c = F.when(F.col("top") > 0, F.col("context") / F.col("top")).otherwise(F.col("context"))
    x = scored.crossJoin(F.broadcast(top)).withColumn("share", c)
    return x.withColumn("boosted", F.col("score") * (1 + F.col("share"))).withColumn("tie_break", F.col("score") + 1e-6 * F.col("share")).drop("top", "share")


def ring_context(earlier: DataFrame, edges: DataFrame, nodes: DataFrame, rare: int = SETTINGS.rare_entity) -> DataFrame:
    """user_id, in_previous_ring, previous_ring_confidence, neighbours_in_previous_rings and
    rare_entity_overlap_with_previous_rings (the share of an account's rare edges that reach a member) of
    nodes(user_id). earlier(user_id, confidence): members of an earlier window's rings; edges: today's."""
    ring = earlier.groupBy("user_id").agg(F.max("confidence").alias("confidence"))
    both = F.array(F.struct(F.col("src").alias("user_id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("user_id"), F.col("src").alias("nbr")))
    ways = edges.select(F.explode(both).alias("e"), (F.col("min_entity_size") <= rare).alias("rare")).select("e.*", "rare")
    hit = ways.join(ring.select(F.col("user_id").alias("nbr"), F.lit(1).alias("hit")), "nbr", "left")
    near = hit.groupBy("user_id").agg(F.count("hit").alias("neighbours"), F.count_if("rare").alias("rare"), F.count_if(F.col("rare") & F.col("hit").isNotNull()).alias("rare_hit"))
    x = nodes.select("user_id").join(ring, "user_id", "left").join(near, "user_id", "left")
    share = F.when(F.col("rare") > 0, F.col("rare_hit") / F.col("rare")).otherwise(0.0)
    return x.select("user_id", F.col("confidence").isNotNull().cast("double").alias("in_previous_ring"), F.coalesce("confidence", F.lit(0.0)).alias("previous_ring_confidence"), F.coalesce("neighbours", F.lit(0)).alias("neighbours_in_previous_rings"), share.alias("rare_entity_overlap_with_previous_rings"))


def assert_horizon(context_days: tuple[int, int], feature_days: tuple[int, int]) -> int:
    """Days between two windows; raises unless every context day precedes every feature day."""
    if context_days[1] >= feature_days[0]:
        raise ValueError(f"context days {context_days} are not before feature days {feature_days}")
    return feature_days[0] - context_days[1]
