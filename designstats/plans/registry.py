"""Name -> (query, oracle SQL) registry."""

import sys
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def forget(spark) -> None:
    """Drop fits, tables and designs kept by earlier queries, so that the next one starts cold."""
    for name, module in list(sys.modules.items()):
        if name.startswith("designstats.plans."):
            for value in vars(module).values():
                if hasattr(value, "cache_clear"):
                    value.cache_clear()
    spark.catalog.clearCache()
