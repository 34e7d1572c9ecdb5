"""Registered queries (one module per operator family)."""

import importlib

MODULES = [
    "trace_queries",
    "vector_queries",
    "text_queries",
    "truth_queries",
    "label_queries",
    "score_queries",
    "learn_queries",
    "io_queries",
]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
