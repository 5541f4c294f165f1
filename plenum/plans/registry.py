"""Where query modules enter their queries and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def enter(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return enter


#: The events table as discourse records: actor, theme, category, stance, case and threads.
EV = """ev AS (SELECT event_id, user_id AS actor, event_type AS category, ts, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) % 20 AS theme, user_id % 2 AS case_id,
  CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.5 WHEN 'error' THEN -1.0 ELSE 0.0 END AS stance,
  CAST(CAST(ts AS DATE) AS VARCHAR) AS day, strftime(ts, '%Y-%m-%d %H') AS hour FROM events)"""


def discourse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    stance = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "signup", 0.5).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("category"), "ts", "value", k.alias("k"), (k % 20).alias("theme"), (F.col("user_id") % 2).alias("case_id"),
        stance.alias("stance"), F.to_date("ts").cast("string").alias("day"), F.date_format("ts", "yyyy-MM-dd HH").alias("hour"),
    )
