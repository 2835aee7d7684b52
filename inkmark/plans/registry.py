"""All registered queries and their SQL."""

from __future__ import annotations

from inkmark.plans import cleaning, evaluation, features, flagship, sources, splitting, streams, training

MODULES = (sources, cleaning, splitting, features, evaluation, flagship, training, streams)


def all_queries() -> dict:
    return {name: function for module in MODULES for name, function in module.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
