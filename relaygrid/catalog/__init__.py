"""The registered queries: operators applied to the given tables."""

from relaygrid.catalog import flows, lookups, registry, rollups, rows  # noqa: F401  (registers queries)


def queries():
    return dict(registry.QUERIES)


def checks():
    return dict(registry.CHECKS)
