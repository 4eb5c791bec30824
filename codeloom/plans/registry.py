"""All queries of the core, by name."""

from codeloom.plans import extraction, graph, references

_MODULES = [references, graph, extraction]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
