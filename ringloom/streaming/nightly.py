"""Nights: growing prefixes of days, and cases followed from night to night.

The batch fold is the definition; as_stream runs the same step per micro-batch of a stream of
nights, for which the state is the last night's table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringloom.operators.graph import build_graph
from ringloom.operators.iterate import cut
from ringloom.operators.rings import match_night


def prefixes(orders: DataFrame, nights: list[int]) -> Iterator[tuple[int, DataFrame]]:
    """(night, orders up to and with it)."""
    for n in nights:
        yield n, orders.where(F.col("day_ordinal") <= n)


def replay(orders: DataFrame, nights: list[int], rings_of: Callable[[int, DataFrame, DataFrame], DataFrame]) -> Iterator[tuple[int, DataFrame]]:
    """(night, rings) with the graph built anew each night: rings_of(night, orders, edges)."""
    for night, upto in prefixes(orders, nights):
        yield night, rings_of(night, upto, build_graph(upto))


class Tracker:
    """Cases over nights: observe(night, rings(ring_id, user_id)) -> case_id, ring_id, event."""

    def __init__(self, theta: float = 0.3):
        self.theta, self.next_id, self.fronts = theta, 1, None

    def observe(self, night: int, rings: DataFrame) -> DataFrame:
        rings = cut(rings.select("ring_id", "user_id").distinct())
        fronts = self.fronts if self.fronts is not None else rings.limit(0)
        events = cut(match_night(fronts, rings, self.theta, self.next_id))
        alive = events.where("event in ('born', 'split', 'continued', 'merged')")
        self.fronts = cut(rings.join(alive.select("case_id", "ring_id"), "ring_id").select(F.col("case_id").alias("ring_id"), "user_id"))
        self.next_id += events.where("event in ('born', 'split')").count()
        return events.withColumn("night", F.lit(night))

    def as_stream(self, stream: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str | None = None):
        """Start a query over a stream of (night, ring_id, user_id), a night or more per batch.
        checkpoint: the shared folder that says which nights are done."""

        def step(batch: DataFrame, _: int) -> None:
            for r in batch.select("night").distinct().orderBy("night").collect():
                sink(self.observe(r.night, batch.where(F.col("night") == r.night)))

        writer = stream.writeStream.foreachBatch(step)
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
