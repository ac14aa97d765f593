"""Every operator as a query over the test tables, with the equivalent SQL where SQL can say it."""

from importlib import import_module

MODULES = ("analytics", "fields", "chunking", "search", "quality", "ingestion")


def all_checks():
    """(queries, oracle SQL) by name."""
    from checks import registry

    for name in MODULES:
        import_module(f"checks.{name}")
    return registry.QUERIES, registry.ORACLES
