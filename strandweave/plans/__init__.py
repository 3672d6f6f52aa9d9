"""Registered queries: each operator applied to the driver tables, with equivalent SQL."""

from importlib import import_module

MODULES = ("interval_queries", "evidence_queries", "sequence_queries", "scan_queries")


def load_all() -> None:
    for m in MODULES:
        import_module(f"{__name__}.{m}")
