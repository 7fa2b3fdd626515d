"""Scalar functions of the SQL dialect, as expressions of built-in Spark functions."""

from tessera.functions.library import FUNCTIONS, call, expand

__all__ = ["FUNCTIONS", "call", "expand"]
