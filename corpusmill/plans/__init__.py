"""Queries over the given tables, one module per group of operators."""

import importlib

MODULES = ["scalars", "extract", "facts", "relational", "retrieval", "chunks", "answers"]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"corpusmill.plans.{name}")
