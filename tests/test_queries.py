"""Registered queries against their SQL, and those that SQL cannot express for their invariants."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from tests.compare import same
from tests.conftest import DATA
from wayline.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark: SparkSession, name: str) -> None:
    same(registry.QUERIES[name](spark, DATA).toPandas(), registry.ORACLE_SQL[name], DATA)


def test_dedupe_fold_invariants(spark: SparkSession) -> None:
    got = registry.QUERIES["dedupe_fold"](spark, DATA).toPandas()
    assert got.id.is_unique and len(got) == 1000
    roots = got[got.match.isna()]
    assert (roots.id == roots.canonical_id).all() and set(got.canonical_id) <= set(roots.id)
    assert (got.seen_count >= 1).all() and set(got.match.dropna()) <= {"same_source", "same_drive", "prior_drive"}


def test_other_queries_have_rows(spark: SparkSession) -> None:
    for name in ("eval_bootstrap", "capture_gate_fixes", "highway_matches", "route_precedence", "highway_tiles", "fuzzy_places"):
        assert registry.QUERIES[name](spark, DATA).count() > 0, name
    towns = {r["location"]: (r["lgd"], r["how"]) for r in registry.QUERIES["fuzzy_places"](spark, DATA).collect()}
    assert towns["AFRICA City Corporation"] == ("100", "exact") and towns["AMERICAA City Corporation"][1] in ("exact", "similar")
