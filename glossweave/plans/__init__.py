"""Named queries over a folder of Parquet tables, and their SQL."""

from glossweave.plans import nested, reference

_MODULES = (nested, reference)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
