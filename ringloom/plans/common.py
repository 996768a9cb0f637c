"""Inputs that queries share, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.operators import graph
from ringloom.sources import adapter

BASE = f"with recursive {adapter.SQL}"
MEMBERS = (
    BASE
    + """,
long_ as (
  select 'r1' as rel, 0 as bit, r1 as entity, user_id from orders_ union all
  select 'r3', 1, r3, user_id from orders_ union all
  select 'r6', 2, r6, user_id from orders_ union all
  select 'r7', 3, r7, user_id from orders_ union all
  select 'r8', 4, r8, user_id from orders_),
members_ as (select distinct rel, bit, entity, user_id from long_ where entity is not null),
sizes_ as (select rel, entity, count(*) as size from members_ group by all),
capped_ as (select * from members_ join sizes_ using (rel, entity) where size between 2 and 100)"""
)
EDGES = (
    MEMBERS
    + """,
pairs_ as (
  select a.rel, a.bit, a.size, a.user_id as src, b.user_id as dst, (1 / ln(2.0::double + a.size))::float as w
  from capped_ a join capped_ b on a.rel = b.rel and a.entity = b.entity and a.user_id < b.user_id),
edges_ as (
  select src, dst, sum(w::double)::float as weight, bit_count(bit_or((1 << bit)::integer)) as n_relations, bit_or((1 << bit)::integer) as relation_mask, min(size) as min_entity_size
  from pairs_ group by src, dst),
ways_ as (select src as node, dst as nbr, * exclude (src, dst) from edges_ union all select dst, src, * exclude (src, dst) from edges_)"""
)
#: A ring that is given: the accounts of an r1 entity, five or more.
RINGS = MEMBERS + ",\nrings_ as (select entity as ring_id, user_id from capped_ where rel = 'r1' and size >= 5)"
EDGE_RINGS = EDGES + ",\nrings_ as (select entity as ring_id, user_id from capped_ where rel = 'r1' and size >= 5)"


def edges(spark, sf_dir) -> DataFrame:
    return graph.build_graph(adapter.orders(spark, sf_dir))


def rings(spark, sf_dir) -> DataFrame:
    """ring_id, user_id: the accounts of an r1 entity, five or more."""
    cap = graph.capped(graph.members(adapter.orders(spark, sf_dir), ("r1",)), least=5)
    return cap.select(F.col("entity").alias("ring_id"), "user_id")


def ranked_rings(spark, sf_dir, top: int = 200) -> DataFrame:
    """The largest rings, with rank and user_id."""
    r = rings(spark, sf_dir)
    n = r.groupBy("ring_id").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "ring_id").limit(top)
    from pyspark.sql import Window

    n = n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "ring_id")))
    return r.join(F.broadcast(n), "ring_id").select("rank", "ring_id", "user_id")


RANKED = RINGS + ",\nsized_ as (select ring_id, count(*) as size from rings_ group by 1 order by size desc, ring_id limit 200),\nplaced_ as (select ring_id, row_number() over (order by size desc, ring_id) as rank from sized_),\nranked_ as (select rank, ring_id, user_id from placed_ join rings_ using (ring_id))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles and floats rounded, whole numbers as long, so that engines can be compared. What
    is added keeps values halfway between two steps from going either way."""
    up = 1e-9 if digits == 6 else 0.0
    cast = {"double": lambda c: F.round(F.col(c) + up, digits), "float": lambda c: F.round(F.col(c).cast("double") + up, digits), "int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long"), "tinyint": lambda c: F.col(c).cast("long")}
    return df.select(*((cast[k](c) if k in cast else F.col(c)).alias(c) for c, k in df.dtypes))
