"""Queries that join two tables as of a position."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.asof import as_of
from . import bindings as B
from .registry import query

_SQL = """
  WITH l AS (SELECT user_id AS worker, event_id, event_id // 4 AS at FROM events WHERE event_type = 'error'),
  r AS (SELECT user_id AS worker, event_id // 4 AS at, max(event_id) AS lease FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
  SELECT l.worker, l.event_id, r.at AS matched_at, r.lease FROM l ASOF LEFT JOIN r ON l.worker = r.worker AND l.at {} r.at"""


def _tables(spark, sf):
    """Errors, and the leases that workers took, both by a coarse position, so that some fall together."""
    rows = B.table(spark, sf, "events").select(F.col("user_id").alias("worker"), "event_id", F.floor(F.col("event_id") / 4).alias("at"), "event_type")
    errors = rows.where("event_type = 'error'").drop("event_type")
    return errors, rows.where("event_type = 'purchase'").select("worker", "at", F.col("event_id").alias("lease"))


@query("lease_as_of", _SQL.format(">="))
def lease_as_of(spark, sf):
    """The lease a worker held when an error came, taken at the same time or before."""
    return as_of(*_tables(spark, sf), ["worker"], "at", ["lease"]).drop("at")


@query("lease_before", _SQL.format(">"))
def lease_before(spark, sf):
    """The lease a worker had taken strictly before an error came."""
    return as_of(*_tables(spark, sf), ["worker"], "at", ["lease"], strict=True).drop("at")
