"""Analytics over fleets of phone-walk recordings, as Spark DataFrame jobs."""

from .session import build_session, checkpointed

__all__ = ["build_session", "checkpointed"]
