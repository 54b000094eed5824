"""Registered queries: each operator applied to the fixture tables, with its SQL check."""

from importlib import import_module

MODULES = ("searching", "detecting", "grouping", "segmenting", "texting", "coding", "storing", "clustering", "live")


def load_all() -> None:
    """Import every workload module once; importing registers its queries."""
    for name in MODULES:
        import_module(f"mediaops.workloads.{name}")
