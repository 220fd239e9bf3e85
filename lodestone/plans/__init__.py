"""The queries, by family; importing a module registers them."""

from importlib import import_module

FAMILIES = ("graph", "analytics", "risk", "journal", "text", "search", "resolve", "streaming", "sources", "locate", "lineage", "edits")


def load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
