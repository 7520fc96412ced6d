"""Frames derived from the driver tables for checks the clean tables cannot
exercise (they hold no nulls and no repeated rows).

``dirty_events``: every row of ``events`` with nulls written into a fixed
pattern of cells, plus a second copy of a fixed set of rows.  The same
derivation is spelled as a CTE for the oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.sources.tables import read_table

DIRTY_CTE = """
WITH dirty_base AS (
  SELECT event_id,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS user_id,
         CASE WHEN event_id % 11 = 0 OR event_id % 97 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 OR event_id % 97 = 0 THEN NULL ELSE value END AS value,
         ts
  FROM events),
dirty AS (SELECT * FROM dirty_base UNION ALL SELECT * FROM dirty_base WHERE event_id % 50 = 0)
"""


def dirty_events(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    k = F.col("event_id")
    base = ev.select(
        "event_id",
        F.when(k % 97 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
        F.when((k % 11 == 0) | (k % 97 == 0), F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when((k % 7 == 0) | (k % 97 == 0), F.lit(None)).otherwise(F.col("value")).alias("value"),
        "ts")
    return base.unionByName(base.filter(k % 50 == 0))
