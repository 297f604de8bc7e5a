"""Registered queries, grouped by area; importing a module registers what it holds."""

import importlib

MODULES: tuple[str, ...] = ("retrieval", "cleaning", "grounding", "deadlines", "ledger", "evaluation", "relational", "answers", "case", "casebook", "state")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
