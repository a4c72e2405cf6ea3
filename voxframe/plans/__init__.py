"""Registered queries: operators wired to the test tables, with their SQL."""

from importlib import import_module

AREAS = ("metrics", "topology", "preparing", "splitting", "auditing", "audits", "runs", "dense", "storage", "documents")


def load_catalog():
    """Import every area once and return the query and oracle maps."""
    for area in AREAS:
        import_module(f"{__name__}.{area}")
    catalog = import_module(f"{__name__}.catalog")
    return catalog.QUERIES, catalog.ORACLE
