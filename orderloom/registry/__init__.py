"""All registered queries, by area."""

from importlib import import_module

_AREAS = ("analytics", "sources", "lookups", "changes", "workload", "requests", "streaming", "synthetic")


def areas():
    return [import_module(f"orderloom.registry.{area}").registry for area in _AREAS]
