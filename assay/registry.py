"""All queries of the evaluation operators, and the SQL that says the same."""

from __future__ import annotations

from assay.catalog import executables, files, hashes, made, metrics, modules, more, records, rendered, reports, scalars, selection, structure, time, values  # noqa: F401
from assay.catalog.base import ORACLE_SQL as ORACLE_SQL
from assay.catalog.base import QUERIES as QUERIES
