"""All registered queries of the engine and their DuckDB twins.

Roles of the driver tables: ``documents`` are comments or news (group: source),
``benchmark`` is held-out text, ``labels`` are reviewed labels, ``part`` and
``customer`` names are vocabularies, ``events`` is an append-only log.
"""

from __future__ import annotations

from . import evaluation, files, lexicons, lookups, selection, texts

QUERIES: dict = {}
SQL: dict = {}
for _module in (texts, selection, lexicons, evaluation, lookups, files):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
