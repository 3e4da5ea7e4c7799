"""Registered queries on the benchmark tables, each next to its SQL check."""

from __future__ import annotations

import importlib

from tessera.plans import registry

_FAMILIES = (
    "evidence_queries", "emission_queries", "prior_queries", "learning_queries", "label_queries",
    "prediction_queries", "spatial_queries", "boltzmann_queries", "reporting_queries",
)


def load() -> None:
    for name in _FAMILIES:
        importlib.import_module(f"tessera.plans.{name}")


def queries():
    load()
    return dict(registry.QUERIES)


def oracles():
    load()
    return dict(registry.ORACLES)
