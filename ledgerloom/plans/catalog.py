"""Imports every module that registers queries."""

from importlib import import_module

MODULES = ["relations", "kpis", "access", "quality", "alerts", "workshop", "fraud", "hub", "sensors", "airline", "office", "files", "streams", "pages"]


def load() -> None:
    for name in MODULES:
        import_module(f"{__package__}.{name}")
