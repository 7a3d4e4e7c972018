"""Every operator as a registered query over the test tables."""

from importlib import import_module

from tidemark.queries.registry import ORACLES, QUERIES

MODULES = ["sources", "records", "scalars", "retrieval", "features", "evaluation", "experiments", "incremental"]


def _load() -> None:
    for name in MODULES:
        import_module(f"tidemark.queries.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
