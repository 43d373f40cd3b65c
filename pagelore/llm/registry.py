"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from pagelore.runtime import ship

#: query -> module; a module's SQL, if it has one, is the query's oracle.
MODULES = {
    "op1_toxicity": "toxicity",
    "op2_line_dedup": "line_dedup",
    "op3_chat_format": "chat",
    "op4_mix_sources": "mixing",
    "op5_simhash_dedup": "simhash",
    "op6_token_counts": "token_counts",
    "op7_bpe_round_trip": "bpe",
    "op8_exact_dedup": "exact_dedup",
    "op9_nearest_neighbours": "nearest",
    "op10_language_id": "language_id",
}


def _query(name, module):
    f = getattr(import_module(f"pagelore.llm.{module}"), name)

    @wraps(f)
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries():
    return {name: _query(name, module) for name, module in MODULES.items()}


def oracle_sql():
    sql = {name: getattr(import_module(f"pagelore.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {k: v for k, v in sql.items() if v}
