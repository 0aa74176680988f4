"""Registered queries of the road-observation engine and the SQL that checks them."""

from __future__ import annotations

from wayline.plans import observations, places, records, reports
from wayline.plans.define import Query

QUERIES: dict[str, Query] = observations.book.queries | places.book.queries | records.book.queries | reports.book.queries
ORACLE_SQL: dict[str, str] = observations.book.sql | places.book.sql | records.book.sql | reports.book.sql
