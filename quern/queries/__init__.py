"""The query catalogue: each entry runs over its whole tables, beside the SQL that gives the same rows."""

from __future__ import annotations

from . import scans, surface

QUERIES = {**scans.QUERIES, **surface.QUERIES}
ORACLE_SQL = {**scans.ORACLE_SQL, **surface.ORACLE_SQL}
