"""Registry of the core queries: one module per family, each with a REGISTRY of name -> (query, oracle SQL or None)."""

from __future__ import annotations

from measura.plans import bodies, crystal, files, forms, games, lattice, measures, noise, planned, programs, relational, sequence, sift, streams, text, trees

FAMILIES = (relational, text, sequence, sift, programs, lattice, noise, games, measures, streams, files, forms, trees, planned, crystal, bodies)

QUERIES = {name: query for family in FAMILIES for name, (query, _) in family.REGISTRY.items()}
ORACLES = {name: sql for family in FAMILIES for name, (_, sql) in family.REGISTRY.items() if sql}
