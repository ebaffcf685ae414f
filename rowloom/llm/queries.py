"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module that defines a function of that name; a module may also define SQL.
MODULES = {
    "op1_embedding_near_dedup": "multiindex",
    "op2_sentencepiece": "pieces",
    "op3_url_filters": "urlfilter",
    "op4_substring_dedup": "substrings",
    "op5_mixing": "mixing",
    "op6_sharding": "sharding",
    "op7_nearest_neighbours": "descent",
    "op8_minhash_near_dedup": "minhash",
    "op9_language_id": "languages",
    "op10_html_extraction": "webpages",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
