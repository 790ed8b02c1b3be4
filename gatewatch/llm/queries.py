"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name and the module that defines a function of that name.
MODULES = {
    "op1_html": "html",
    "op2_warc": "warc",
    "op3_decontaminate": "decontaminate",
    "op4_language": "langid",
    "op5_bpe": "bpe",
    "op6_quality": "quality",
    "op7_repeated_substrings": "substrings",
    "op8_fingerprint": "fingerprints",
    "op9_near_duplicates": "neardup",
    "op10_secret_scan": "secrets",
    "op11_collocations": "collocations",
    "op12_jaccard_join": "jaccard",
    "op13_whitening": "whitening",
}
#: Modules that hold SQL, each in a dictionary ORACLE_SQL.
SQL: tuple[str, ...] = ("collocations", "warc")


def queries() -> dict:
    found = {}
    for name, module in MODULES.items():
        found[name] = getattr(importlib.import_module(f"{__package__}.{module}"), name)
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in SQL:
        found |= importlib.import_module(f"{__package__}.{module}").ORACLE_SQL
    return found
