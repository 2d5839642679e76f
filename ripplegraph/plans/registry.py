"""Named queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_graph, catalog_stats, catalog_text, catalog_triples  # noqa: F401  they register their queries
from .runtime import ORACLES as ORACLES
from .runtime import QUERIES as _made
from .runtime import frames


def _bound(make: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(frames(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _bound(make) for name, make in _made.items()}
