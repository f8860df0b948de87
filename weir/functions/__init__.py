"""The scalar function library: builders of Spark columns, by name."""

from .registry import FUNCTIONS, Arg, build, catalog, register

__all__ = ["FUNCTIONS", "Arg", "build", "catalog", "register"]
