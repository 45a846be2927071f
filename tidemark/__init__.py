"""tidemark: point-in-time market evidence as PySpark DataFrame operators."""

from tidemark.session import build_session, pin_session

__all__ = ["build_session", "pin_session"]
