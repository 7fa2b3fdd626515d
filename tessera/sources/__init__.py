"""Table sources."""

from tessera.sources.tables import table, register

__all__ = ["table", "register"]
