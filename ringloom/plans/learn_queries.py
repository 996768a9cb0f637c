"""Queries that fit models: results depend on the learner, so rows only are compared."""

from __future__ import annotations

from ringloom.operators import features, learn, metrics
from ringloom.sources import adapter

from .registry import query

COLUMNS = ["n_orders", "n_distinct_sku", "promo_order_rate", "active_days", "day_concentration", "longest_gap_days"]


@query()
def boosted_scores(spark, sf_dir):
    """Calibrated boosted-tree scores of all accounts."""
    f = features.order_features(adapter.orders(spark, sf_dir))
    folds = metrics.split(adapter.accounts(spark, sf_dir))
    return learn.fit(f, folds, COLUMNS, trees=10, depth=3).score(f)
