"""The queries of this subpackage, and their SQL where SQL can express them."""

from importlib import import_module

MODULES = ["url_rules", "chat", "pii", "toxicity", "quality", "mixing", "sharding", "vectors", "jaccard", "decontam", "repair", "spelling", "language"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
