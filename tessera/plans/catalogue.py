"""All registered queries and their SQL twins."""

from __future__ import annotations

from tessera.plans import annotations, curation, dedup, evidence, features, inspection, metrics, streams, temporal

MODULES = [dedup, curation, annotations, inspection, temporal, metrics, features, evidence, streams]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
