"""weir: a streaming-SQL analytics engine built on Spark's DataFrame API."""

from .plans.planner import Options, plan, run
from .plans.syntax import SqlError, parse

__all__ = ["Options", "SqlError", "parse", "plan", "run"]
