"""How a query and its SQL are written side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
Tables = Callable[[str], DataFrame]

#: Microseconds since 1970 of events.ts, which has no time zone.
MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


@dataclass
class Book:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
        """Registers a function of tables by its name, with DuckDB SQL for the same rows if SQL can say it."""

        def register(build: Callable[[Tables], DataFrame]) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            self.queries[build.__name__] = run
            if sql:
                self.sql[build.__name__] = sql
            return run

        return register


def fixes(table: Tables) -> DataFrame:
    """events as positions near one city: a grid of 1000 by 100 points."""
    return table("events").select(
        "event_id", "user_id", "event_type", "value", "ts", F.expr(MICROS).alias("us"),
        (12.9 + F.col("event_id") % 1000 / 10_000).alias("lat"), (77.6 + F.col("user_id") % 100 / 10_000).alias("lng"),
    )


FIXES_SQL = """
fixes AS (
  SELECT event_id, user_id, event_type, value, ts, epoch_us(ts) AS us,
         CAST(12.9 AS DOUBLE) + CAST(event_id % 1000 AS DOUBLE) / 10000 AS lat,
         CAST(77.6 AS DOUBLE) + CAST(user_id % 100 AS DOUBLE) / 10000 AS lng
  FROM events)"""

HAVERSINE_SQL = "2 * 6371000.0 * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2)))"
