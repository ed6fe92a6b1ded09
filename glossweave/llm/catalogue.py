"""The subpackage's named queries and their SQL."""

from glossweave.llm import canonical, consensus, leaks, linkage, mojibake, packing, spam, variants

_MODULES = (variants, canonical, linkage, consensus, mojibake, packing, leaks, spam)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
