"""Named queries over the test tables and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict = {}
_ORACLE: dict = {}


def _load() -> None:
    from tidewatch.plans import aggregates, alerts, domain, evaluation, exposure, joins, lineage, scalars, series, sites, statements, upkeep  # noqa: F401  they register themselves


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    """Query name -> DuckDB SQL."""
    _load()
    return dict(_ORACLE)


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle if it has one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
