"""Fields over the driver's tables, and the SQL fragments that say the same to DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import GridSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GridSpec]:
    """events as a 10 x 10 x n grid: cell_id, x, y, z, value, user_id. event_id is dense."""
    e = table(spark, sf_dir, "events")
    n = e.agg(F.max("event_id")).first()[0] + 1
    grid = GridSpec((10, 10, -(-n // 100)))
    x, y, z = grid.coordinates(F.col("event_id"))
    return e.select(F.col("event_id").alias("cell_id"), x.alias("x"), y.alias("y"), z.alias("z"), "value", "user_id"), grid


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and the first components of its embedding as doubles u, v, w, and s, t, r."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate("uvwstr")])


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


#: DuckDB views of the same fields.
CELLS = "cells AS (SELECT event_id AS cell_id, CAST(event_id % 10 AS INTEGER) AS x, CAST((event_id // 10) % 10 AS INTEGER) AS y, CAST(event_id // 100 AS INTEGER) AS z, value, user_id FROM events)"
VECS = "vecs AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate("uvwstr")) + " FROM embeddings)"


def sql_bin(v: str, n: int | str, lo: str = "lo", hi: str = "hi") -> str:
    return f"CAST(CASE WHEN {hi} <= {lo} THEN 0 ELSE least(greatest(floor(({v} - {lo}) / (({hi} - {lo}) / CAST({n} AS DOUBLE))), 0), {n} - 1) END AS INTEGER)"


def sql_entropy(source: str, keys: str = "", n: str = "n", norm: int | None = None) -> str:
    """SELECT of the entropy of counts, grouped by keys."""
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    h = f"greatest(log2(sum({n})) - sum(CASE WHEN {n} > 0 THEN {n} * log2(CAST({n} AS DOUBLE)) ELSE 0 END) / sum({n}), 0)"
    return f"SELECT {k}round({h}{f' / log2({norm})' if norm else ''}, 6) AS entropy FROM {source}{g}"
