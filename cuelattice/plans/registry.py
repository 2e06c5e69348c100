"""Registry of runnable queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.kernel.scan import sized_for

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# How many rows one key of a source turns into, per source table: SQL text, so that importing needs no session.
_KEY_WEIGHT = {
    "documents": ("doc_id", r"size(split(text, r'[ \n\t\r]+'))"),
    "events": ("user_id", "1"),
    "lineitem": ("l_orderkey", "1"),
    "conversations": ("conv_id", "octet_length(text)"),
}


def query(name: str, oracle: str | None = None, sized: str = "") -> Callable[[Query], Query]:
    """Register a query. ``sized`` names the source tables whose largest key decides the scan plan."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            measured = [
                (spark.read.parquet(f"{sf}/{table}.parquet"), [_KEY_WEIGHT[table][0]], F.expr(_KEY_WEIGHT[table][1]))
                for table in sized.split()
            ]
            with sized_for(*measured):
                return fn(spark, sf)

        QUERIES[name] = run if sized else fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
