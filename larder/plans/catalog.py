"""All queries of the core."""

from __future__ import annotations

from larder.plans import answers, documents, matching, pipeline, quantities

MODULES = (documents, answers, matching, pipeline, quantities)


def runs() -> dict:
    return {name: run for module in MODULES for name, run in module.registry.runs.items()}


def sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.registry.sql.items()}
