"""The same queries over unbounded streams, with Structured Streaming."""

from .runner import StreamingQueryPlan, start_query

__all__ = ["StreamingQueryPlan", "start_query"]
