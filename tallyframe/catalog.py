"""name -> query and name -> DuckDB SQL of the library's own operators, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function (tables, spark) -> DataFrame under a name, with its SQL where there is one. tables is
    a function that reads a table of the query's folder by name."""

    def keep(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark)

        run.__name__, run.__doc__ = name, f.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return keep


from tallyframe.plans import contract, events, learning, manifest, market, metrics, pixels, relations, scoring, sequential, stats, streams  # noqa: E402, F401
