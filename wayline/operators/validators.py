"""Rules of the tables that a release is made of: contracts, authorities, manifests and regions.

Each set of rules is a table of names and Column predicates, so one scan of the rows tells every rule that each breaks;
rules over several rows (unique keys, names that collide) are aggregations of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.geo import self_intersects, valid_ring
from wayline.functions.text import well_formed
from wayline.operators.authorities import alias_collisions
from wayline.operators.tables import duplicated, violations

#: Most rows of a contract pack, most bytes of a resource, and the launchable packages by default.
MOST_TENDERS, MOST_BYTES = 100_000, 16_777_216
BODY_CODE, TENDER_DATE, ISO_DATE = r"^(?:BLR|[0-9]{3,12})$", r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
REGION_ID = r"^[a-z0-9][a-z0-9-]{2,100}$"


def _text(column: str, most: int, least: int = 1) -> Column:
    return F.length(column).between(least, most)


def _texts(column: str, least: int, most: int, longest: int) -> Column:
    return F.size(column).between(least, most) & F.forall(column, lambda x: F.coalesce(F.length(x).between(1, longest), F.lit(False)))


def _if_given(column: str, rule: Column) -> Column:
    return F.coalesce(F.col(column) == "", F.lit(True)) | rule


def tender_rules() -> dict[str, Column]:
    """Rules of contract rows (tn, t, loc, c, d, b)."""
    return {
        "number": _text("tn", 100), "title": _text("t", 500), "location": _text("loc", 200, 0), "contractor": _text("c", 200, 0),
        "date": F.col("d").rlike(TENDER_DATE), "body": F.col("b").rlike(BODY_CODE),
    }


def authority_rules(packages: Sequence[str] = ()) -> dict[str, Column]:
    """Rules of authorities: identity, and a way to reach each, by mail or by an official hand-off."""
    https = lambda c: well_formed(F.col(c), "https")
    given = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return {
        "id": well_formed(F.col("authority_id"), "authority_id"), "name": _text("name", 200),
        "email": _if_given("officer_email", well_formed(F.col("officer_email"), "email")),
        "handoff": given("officer_email") | (given("handoff_name") & https("handoff_url")),
        "handoff_https": _if_given("handoff_url", https("handoff_url")),
        "alternate": (given("alternate_handoff_name") == given("alternate_handoff_url")) & _if_given("alternate_handoff_url", https("alternate_handoff_url")),
        "package": _if_given("handoff_package", well_formed(F.col("handoff_package"), "package") & F.col("handoff_package").isin(*packages)),
        "whatsapp": _if_given("whatsapp_url", well_formed(F.col("whatsapp_url"), "whatsapp")),
        "helpline": _if_given("helpline", well_formed(F.col("helpline"), "helpline")),
        "aliases": F.col("aliases").isNull() | _texts("aliases", 0, 30, 100),
    }


def resource_rules(site_root: str) -> dict[str, Column]:
    """Rules of manifest entries (entry_id and readers.RESOURCE): a resource's path carries its state, kind and digest."""
    path = F.concat(F.lit(r"packs/v1/states/"), F.lower("state_code"), F.lit("/"), "kind", F.lit("-"), "sha256", F.lit(".json"))
    return {
        "entry": F.col("pack_id") == F.col("entry_id"), "kind": F.col("kind").isin("routing", "tenders"), "versions": (F.col("pack_version") == 1) & (F.col("schema_version") == 1),
        "digest": well_formed(F.col("sha256"), "sha256"), "path": F.col("path") == path, "url": F.col("url") == F.concat(F.lit(site_root), "path"), "bytes": F.col("bytes").between(1, MOST_BYTES),
        "scope": _text("coverage_scope", 200), "statewide": F.col("statewide").isNotNull(), "retrieved": F.col("source_retrieved_at").rlike(ISO_DATE), "review": F.col("review_after").rlike(ISO_DATE),
        "licenses": _texts("licenses", 1, 10, 300), "records": (F.col("kind") != "tenders") | F.col("records").between(1, MOST_TENDERS),
    }


def region_rules() -> dict[str, Column]:
    """Rules of regions with boundaries: ids, and rings that are closed, on the globe, and do not cross themselves."""
    rings = F.flatten("geometry")
    return {
        "id": F.col("region_id").rlike(REGION_ID), "mode": F.col("routing_mode").isin("boundary", "structured_geocode"),
        "rings": (F.size(rings) > 0) & F.forall(rings, valid_ring), "simple": ~F.exists(rings, self_intersects),
    }


def tender_violations(tenders: DataFrame) -> DataFrame:
    """(tn, b, rule): broken rules of contract rows, and `duplicate` once for each number and body that repeats."""
    twice = duplicated(tenders, ["tn", "b"]).select("tn", "b", F.lit("duplicate").alias("rule"))
    return violations(tenders, ["tn", "b"], tender_rules()).unionByName(twice)


def authority_violations(authorities: DataFrame, packages: Sequence[str] = ()) -> DataFrame:
    """(key, rule): broken rules of authorities, ids that repeat, and aliases that name several of them."""
    broken = violations(authorities.withColumn("key", F.col("authority_id")), ["key"], authority_rules(packages))
    twice = duplicated(authorities, ["authority_id"]).select(F.col("authority_id").alias("key"), F.lit("duplicate").alias("rule"))
    names = authorities.select("authority_id", F.explode("aliases").alias("alias"))
    return broken.unionByName(twice).unionByName(alias_collisions(names).select(F.col("alias").alias("key"), F.lit("alias_collision").alias("rule")))
