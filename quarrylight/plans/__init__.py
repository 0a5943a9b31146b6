"""Query plans registered with the driver, one module a section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.plans import evaluation, graphs, ingest, relational, searching, streams, surface, texts
from quarrylight.plans.registry import Query, Tables

_SECTIONS = (texts, relational, searching, graphs, ingest, streams, evaluation, surface)


def flagship(spark: SparkSession, base: str) -> DataFrame:
    """Hybrid search over all chunks: two channels, fusion, boosts and near-duplicate removal."""
    return searching.flagship(Tables(spark, base))


def queries() -> dict[str, Query]:
    return {name: q for section in _SECTIONS for name, q in section.P.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for section in _SECTIONS for name, s in section.P.sql.items()}
