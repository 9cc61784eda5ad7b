"""Operators for training-data pipelines. Nothing outside this subpackage imports it."""

from importlib import import_module

MODULES: tuple[str, ...] = ("packing", "token_file", "quality", "private", "fingerprints", "repeats", "near", "lines", "pieces", "preferences", "periods", "credentials", "prefixes")


def load() -> None:
    """Import the operator modules, which register their queries."""
    for name in MODULES:
        import_module(f"lapak.llm.{name}")
