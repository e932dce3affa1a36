"""The queries of this package and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from importlib import import_module

#: Query, its module here, and the name of its SQL there, if SQL can express it.
QUERIES = {
    "op1_mix_sources": ("mixing", "OP1_SQL"),
    "op2_pii": ("pii", None),
    "op3_secret_scan": ("secrets", None),
    "op4_url_filter": ("urls", "OP4_SQL"),
    "op7_decontamination": ("decontamination", None),
    "op8_quality_classifier": ("gam", None),
    "op9_language_id": ("langid", None),
    "op5_quote_chat": ("quoting", None),
    "op6_quality_rules": ("quality", "OP6_SQL"),
    "op10_jaccard_join": ("jaccard", None),
    "op11_filter_audit": ("audit", "OP11_SQL"),
    "op12_conversation_trie": ("tries", "OP12_SQL"),
    "op13_suffix_dedup": ("suffixes", None),
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, (module, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(import_module(f".{module}", __package__), sql) for name, (module, sql) in QUERIES.items() if sql}
