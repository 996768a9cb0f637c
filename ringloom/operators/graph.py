"""The multi-relation account graph: entities, capped self-join, edges, node views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.config import RELATIONS, SETTINGS

from . import packed


def long_form(orders: DataFrame, relations: tuple[str, ...] = RELATIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """rel, bit, entity, user_id and kept columns: a row for each order and non-null entity."""
    parts = F.array(*(F.struct(F.lit(r).alias("rel"), F.lit(i).alias("bit"), F.col(r).cast("long").alias("entity")) for i, r in enumerate(relations)))
    return orders.select("user_id", *keep, F.explode(parts).alias("e")).select("e.rel", "e.bit", "e.entity", "user_id", *keep).where("entity is not null")


def members(orders: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """rel, bit, entity, user_id: an account counts once per entity, however often it orders."""
    return long_form(orders, relations).repartition("rel", "entity").dropDuplicates(["rel", "entity", "user_id"])


def entity_sizes(mem: DataFrame) -> DataFrame:
    """rel, entity, size: accounts of each entity. mem is distinct."""
    return mem.groupBy("rel", "entity").agg(F.count("*").alias("size"))


def capped(mem: DataFrame, n_max: int = SETTINGS.n_max, least: int = 2) -> DataFrame:
    """Members of entities of least..n_max accounts, with size. Entities beyond the cap
    drop out by their counts, before anything is paired; members() are dealt by entity, so nothing is dealt again."""
    return mem.withColumn("size", F.count("*").over(Window.partitionBy("rel", "entity"))).where(F.col("size").between(least, n_max))


def rarity(size, base: float = SETTINGS.rarity_base):
    """1 / ln(base + size), as a 32-bit float."""
    return (F.lit(1.0) / F.log(F.lit(base) + size)).cast("float")


def triangle(df: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """key, src < dst: all pairs of the user_ids of a group whose size is bounded, from one sorted
    list a group, so each pair is made once."""
    g = df.groupBy(*key).agg(F.array_sort(F.collect_set("user_id")).alias("ids")).where(F.size("ids") >= least)
    one = g.select(*key, "ids", F.posexplode("ids").alias("i", "src"))
    return one.select(*key, "src", F.explode(F.expr("slice(ids, i + 2, size(ids))")).alias("dst"))


def relation_pairs(cap: DataFrame, base: float = SETTINGS.rarity_base) -> DataFrame:
    """rel, bit, entity, src < dst, size, w: every pair of accounts that shares an entity. cap bounds
    an entity's accounts, so its list is short, and the lists need no exchange after the cap's join."""
    return triangle(cap, ["rel", "entity", "bit", "size"]).withColumn("w", rarity(F.col("size"), base))


def aggregate_edges(pairs: DataFrame, alphas: DataFrame | None = None) -> DataFrame:
    """One row per pair: src, dst, weight, n_relations, relation_mask, min_entity_size. A pair that
    shares several entities of a relation has all their weights; a bit only says that there is one.
    alphas(rel, alpha) multiply the weights of their relation."""
    if alphas is not None:
        pairs = pairs.join(F.broadcast(alphas), "rel", "left").withColumn("w", (F.col("w") * F.coalesce("alpha", F.lit(1.0)).cast("float")).cast("float"))
    out = pairs.groupBy("src", "dst").agg(F.sum(F.col("w").cast("double")).alias("weight"), F.expr("bit_or(shiftleft(1, bit))").alias("relation_mask"), F.min("size").alias("min_entity_size"))
    return out.select("src", "dst", F.col("weight").cast("float").alias("weight"), F.bit_count("relation_mask").alias("n_relations"), "relation_mask", "min_entity_size")


def fold_edges(cap: DataFrame, alphas: DataFrame | None = None, base: float = SETTINGS.rarity_base) -> DataFrame:
    """aggregate_edges of relation_pairs, with less to shuffle: of each entity's sorted list an account gets what comes
    after it, and pairs are only made and added up where all lists of their first account are."""
    lists = cap.groupBy("rel", "entity", "bit", "size").agg(F.array_sort(F.collect_set("user_id")).alias("ids")).withColumn("w", rarity(F.col("size"), base))
    if alphas is not None:
        lists = lists.join(F.broadcast(alphas), "rel", "left").withColumn("w", (F.col("w") * F.coalesce("alpha", F.lit(1.0)).cast("float")).cast("float"))
    tails = lists.select("bit", "size", "w", "ids", F.posexplode("ids").alias("i", "src")).where("i < size(ids) - 1").select("src", "bit", "size", "w", F.expr("slice(ids, i + 2, size(ids))").alias("ids"))
    return aggregate_edges(tails.repartition("src").select("src", F.explode("ids").alias("dst"), "bit", "size", "w"))


def account_tails(orders: DataFrame, n_max: int = SETTINGS.n_max, relations: tuple[str, ...] = RELATIONS, among: DataFrame | None = None, sent: int = 1_000_000) -> DataFrame:
    """What the graph is folded from: of each entity within the cap, for each account, those after it. among(user_id): pairs of such
    accounts only, others are just counted; up to `sent` of them (counted) are broadcast, and more are joined."""
    if among is not None:
        live = among.select("user_id").distinct().withColumn("live", F.lit(True))
        orders = orders.join(F.broadcast(live) if live.count() <= sent else live, "user_id", "left").fillna(False, ["live"])
    return packed.tails(packed.entity_blocks(orders, relations), 2, n_max)


def ring_totals(tails: DataFrame, members_: DataFrame, rare: int = SETTINGS.rare_entity) -> DataFrame:
    """members_(ring_id, user_id) -> ring_id, pairs, weight, relation_kinds, top_entity_platform_count, rare_edge_share of the edges
    inside, from account_tails: neither edges nor a ring's pairs are dealt out. Rings without edges have no row."""
    mine = packed.tails(packed.entity_blocks(members_.select("user_id", "ring_id"), ("ring_id",)), 2, None)
    t = packed.ring_totals(tails, mine, rare, SETTINGS.rarity_base)
    return t.select("ring_id", "pairs", "weight", F.bit_count("mask").alias("relation_kinds"), F.col("least").alias("top_entity_platform_count"), (F.col("rare") / F.col("pairs")).alias("rare_edge_share"))


def build_graph(orders: DataFrame, n_max: int = SETTINGS.n_max, days: tuple[int, int] | None = None, relations: tuple[str, ...] = RELATIONS, alphas: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Edges of the accounts of an inclusive range of days, as fold_edges makes them. among(user_id): only those between such
    accounts, with the weights that they have in the whole graph. alphas(rel, alpha) multiply the weights of their relation."""
    if days:
        orders = orders.where(F.col("day_ordinal").between(*days))
    factors = {relations.index(r.rel): np.float32(r.alpha) for r in alphas.collect() if r.rel in relations and r.alpha is not None} if alphas is not None else None
    return packed.edges_of(account_tails(orders, n_max, relations, among), factors, SETTINGS.rarity_base)


def both_ways(edges: DataFrame) -> DataFrame:
    """Two directed rows for each edge: node, nbr and the other columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")))
    return edges.select(F.explode(ends).alias("e"), *rest).select("e.node", "e.nbr", *rest)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes(user_id)."""
    n = nodes.select("user_id").distinct()
    return edges.join(n.withColumnRenamed("user_id", "src"), "src", "left_semi").join(n.withColumnRenamed("user_id", "dst"), "dst", "left_semi").select(edges.columns)


def prune(edges: DataFrame, scores: DataFrame, tau: float = SETTINGS.tau) -> DataFrame:
    """Edges whose ends both score above tau (strictly); tau <= 0 keeps all."""
    return edges if tau <= 0 else induced(edges, scores.where(F.col("score") > tau))


def inner_edges(edges: DataFrame, members_: DataFrame) -> DataFrame:
    """ring_id and the edge's columns, for each edge inside a ring of members_(ring_id, user_id). Pairs of
    a ring's accounts are joined, not all edges of each account; rings are of bounded size."""
    return triangle(members_, ["ring_id"]).join(edges, ["src", "dst"])


def subgraph_totals(edges: DataFrame, members_: DataFrame, scores: DataFrame, lambda_: float) -> DataFrame:
    """members_(ring_id, user_id) -> ring_id, size, internal_weight, score_mass, density."""
    m = members_.select("ring_id", "user_id").distinct()
    inner = inner_edges(edges, m).groupBy("ring_id").agg(F.sum(F.col("weight").cast("double")).alias("internal_weight"))
    mass = m.join(scores, "user_id", "left").groupBy("ring_id").agg(F.count("*").alias("size"), F.sum(F.coalesce("score", F.lit(0.0))).alias("score_mass"))
    return mass.join(inner, "ring_id", "left").fillna(0.0, ["internal_weight"]).withColumn("density", (F.col("internal_weight") + lambda_ * F.col("score_mass")) / F.col("size"))


def close_neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """seeds(user_id) and all accounts within so many hops: an edge that touches the set
    adds both ends."""
    found = seeds.select("user_id").distinct()
    ways = both_ways(edges.select("src", "dst"))
    for _ in range(hops):
        near = ways.join(found.withColumnRenamed("user_id", "node"), "node", "left_semi").select(F.col("nbr").alias("user_id"))
        found = found.union(near).distinct()
    return found


def ball(edges: DataFrame, anchors: DataFrame, reference: DataFrame, cap: int = 3000) -> DataFrame:
    """anchors(anchor) -> anchor, user_id, hop, place: the anchor, its neighbours by weight and
    theirs by the best edge that reaches them, inside reference(user_id), ties by id, at most cap."""
    ways = both_ways(induced(edges.select("src", "dst", "weight"), reference.union(anchors.select(F.col("anchor").alias("user_id"))).distinct()))
    ref = reference.select(F.col("user_id").alias("nbr")).distinct()
    ways = ways.join(ref, "nbr", "left_semi")
    one = anchors.join(ways, F.col("anchor") == F.col("node")).select("anchor", F.col("nbr").alias("user_id"), "weight")
    two = one.select("anchor", F.col("user_id").alias("node")).join(ways.select("node", F.col("nbr").alias("user_id"), "weight"), "node").select("anchor", "user_id", "weight")
    every = anchors.select("anchor", F.col("anchor").alias("user_id"), F.lit(0).alias("hop"), F.lit(0.0).alias("weight")).unionByName(one.withColumn("hop", F.lit(1))).unionByName(two.withColumn("hop", F.lit(2)))
    best = every.groupBy("anchor", "user_id").agg(F.min(F.struct("hop", (-F.col("weight").cast("double")).alias("lost"))).alias("b")).select("anchor", "user_id", "b.*")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy("hop", "lost", "user_id"))
    return best.withColumn("place", place).where(F.col("place") <= cap).select("anchor", "user_id", "hop", "place")


def windows(orders: DataFrame) -> DataFrame:
    """day_ordinal, half: the distinct days present, the first half of them early, the rest late."""
    days = orders.select("day_ordinal").distinct()
    w = Window.orderBy("day_ordinal")  # distinct days only
    return days.select("day_ordinal", F.when(F.row_number().over(w) <= F.floor(F.count("*").over(Window.partitionBy()) / 2), "early").otherwise("late").alias("half"))
