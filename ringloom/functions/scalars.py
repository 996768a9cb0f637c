"""Scalar functions as columns, in one place."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringloom.operators.bursts import size_bucket
from ringloom.operators.cards import distance_band
from ringloom.operators.features import ratio
from ringloom.operators.graph import rarity
from ringloom.operators.metrics import hash_rank
from ringloom.operators.stress import uniform
from ringloom.sources.readers import day_ordinal, ordinal_day


def degree_rarity(alpha, du, dv, base: float = 2.0):
    """alpha / ln(base + the smaller degree): rarity where only adjacency is known."""
    return F.lit(alpha) / F.log(F.lit(base) + F.least(du, dv))


def z_score(x, mean, sd):
    return (x - mean) / F.greatest(sd, F.lit(1e-9))


__all__ = ["day_ordinal", "degree_rarity", "distance_band", "hash_rank", "ordinal_day", "rarity", "ratio", "size_bucket", "uniform", "z_score"]
