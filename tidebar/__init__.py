"""Bar, trade and parameter-sweep analytics as Spark DataFrame jobs."""

from tidebar.session import get_session

__all__ = ["get_session"]
