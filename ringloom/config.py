"""Settings of the engine. Fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

#: Bit i of a relation mask is RELATIONS[i].
RELATIONS = ("r1", "r3", "r6", "r7", "r8")


@dataclass(frozen=True)
class Settings:
    seed: int = 20260902
    n_max: int = 100  # accounts that share an entity, at most
    rarity_base: float = 2.0
    rare_entity: int = 10  # an edge is rare up to this entity size
    k_min: int = 5
    k_max: int = 500
    top_k: int = 25
    tau: float = 0.5
    lambda_: float = 5.0
    g_min: float = 0.0
    held_out: float = 0.25
    validation: float = 0.2
    value_per_order: float = 400.0
    subsidy_per_promo: float = 100.0
    cost_per_minute: float = 10.0
    minutes_base: float = 3.0
    minutes_per_member: float = 0.25


SETTINGS = Settings()
