"""Operators for training data: problems 1 to 10 and their queries."""

from importlib import import_module

MODULES = ("p01_languages", "p02_syntax", "p03_near_copies", "p04_credentials", "p05_generated", "p06_cutoffs", "p07_defects", "p08_tokens", "p09_packing", "p10_sentences")


# Imported at once, so that whoever imports this package learns here whether a library is missing.
_LOADED = [import_module(f"{__name__}.{name}") for name in MODULES]


def queries() -> dict:
    return {name: query for module in _LOADED for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _LOADED for name, sql in getattr(module, "ORACLE", {}).items()}
