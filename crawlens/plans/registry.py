"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from crawlens.plans import audit, crawl, diagnostics, explore, files

QUERIES = {**audit.QUERIES, **explore.QUERIES, **files.QUERIES, **diagnostics.QUERIES, **crawl.QUERIES}
ORACLES = {**audit.ORACLES, **explore.ORACLES, **files.ORACLES, **diagnostics.ORACLES, **crawl.ORACLES}
