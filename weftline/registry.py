"""Queries over the driver's tables, one or more per operator, and SQL for them."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans import chunking, cleaning, clustering, evidence, fusion, lexical, persist, reports, run, services, sources, stored, streams, tagging, vectors
from weftline.shipping import ship

_PLANS = (cleaning, chunking, lexical, vectors, fusion, clustering, services, sources, persist, tagging, evidence, reports, run, stored, streams)


def _plain(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with whole numbers as longs and others as doubles, so that a result has the types of its SQL."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        df = query(spark, sf_dir)
        to = {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}
        return df.select(*(F.col(c).cast(to[t]).alias(c) if t in to else F.col(c) for c, t in df.dtypes))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _plain(f) for p in _PLANS for k, f in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for p in _PLANS for k, s in p.ORACLE_SQL.items()}
