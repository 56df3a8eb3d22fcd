"""All registered queries: name → Spark callable and name → DuckDB SQL."""
from __future__ import annotations

from . import activity_queries, explore_queries, ingest_queries, profile_queries, profile_sql


def spark_queries() -> dict:
    out = {}
    out.update(profile_queries.SPARK)
    out.update(explore_queries.SPARK)
    out.update(ingest_queries.SPARK)
    out.update(activity_queries.SPARK)
    return out


def oracle_queries() -> dict:
    out = {}
    out.update(profile_sql.SQL)
    out.update(explore_queries.SQL)
    out.update(ingest_queries.SQL)
    out.update(activity_queries.SQL)
    return out
