"""Views over the driver tables, the query registry and the matching SQL."""

from importlib import import_module

MODULES = ("feed_queries", "value_queries", "write_queries", "flow_queries", "payload_queries")


def load() -> None:
    """Import the query modules, which register themselves."""
    for name in MODULES:
        import_module(f"lapak.plans.{name}")
