"""Authorities by the names that a place goes by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.text import authority_key

#: What a report keeps of its route; all null unless it is covered.
ROUTE = ("authority_id", "authority_name", "email", "handoff_url")


def matched_authorities(places: DataFrame, aliases: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, authority_id, field): every authority that a place names, with the first field that names it.

    `aliases` has (alias, authority_id); names are compared by their authority keys.
    """
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("name")) for f in fields])
    given = places.select(key, F.posexplode(named).alias("turn", "n")).select(key, "turn", "n.field", authority_key("n.name").alias("alias")).where("alias <> ''")
    known = aliases.select(authority_key("alias").alias("alias"), "authority_id").distinct()
    return given.join(known, "alias").groupBy(key, "authority_id").agg(F.min_by("field", "turn").alias("field"))


def alias_collisions(aliases: DataFrame) -> DataFrame:
    """Aliases that name several authorities."""
    return aliases.groupBy(authority_key("alias").alias("alias")).agg(F.countDistinct("authority_id").alias("authorities")).where("authorities > 1")


def report_routes(routed: DataFrame, authorities: DataFrame, key: str) -> DataFrame:
    """Route columns of reports (key, authority_id, covered): the authority's if covered, else null."""
    joined = routed.select(key, F.when(F.col("covered"), F.col("authority_id")).alias("authority_id")).join(authorities, "authority_id", "left")
    return joined.select(key, *ROUTE)
