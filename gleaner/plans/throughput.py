"""Throughput of a plan: what it stored, by the time that took."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import materialize


def timed(df: DataFrame, present: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Store a plan's result; returns it with its records, seconds and records per second.

    Records are counted in what was stored, so the plan runs once; ``present`` adds, by name, counts of the rows in which a
    column is not NULL. An observation would count them on the way, but a session that has held one can no longer
    train models (its manager is caught in their closures and cannot be sent).
    """
    start = time.perf_counter()
    stored = materialize(df, "timed")
    seconds = time.perf_counter() - start
    counts = [F.count(F.lit(1)).alias("records"), *[F.count(F.col(c)).alias(name) for name, c in (present or {}).items()]]
    found = {name: int(n) for name, n in stored.agg(*counts).first().asDict().items()}
    return stored, {**found, "seconds": round(seconds, 3), "records_per_sec": round(found["records"] / seconds, 1)}
