"""Registered queries over the driver tables and their ANSI SQL counterparts."""

from inkwell.workload.registry import ORACLES, QUERIES, register

__all__ = ["ORACLES", "QUERIES", "load_all", "register"]


def load_all() -> None:
    """Import every workload module so that its queries register themselves."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"inkwell.workload.{name}")


MODULES = (
    "retrieval_queries",
    "memory_queries",
    "rewrite_queries",
    "decision_queries",
    "workspace_queries",
    "stream_queries",
    "layout_queries",
    "corpus_queries",
    "comparison_queries",
)
