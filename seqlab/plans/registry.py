"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the
given tables.  Output columns are aliased identically on both sides; arrays
are emitted as text and timestamps as fixed-width text so the comparison is
hash-stable; doubles are rounded to 6 places on both sides.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # Importing the modules registers their queries.
    from seqlab.plans import q_sessions, q_summary, q_sequences, q_curves, q_inference, q_models, q_extra, q_more, q_sources  # noqa: F401
