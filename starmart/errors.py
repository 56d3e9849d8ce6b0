"""Exception types raised by spec preconditions and mart checks.

Every error is a ``ValueError`` subclass so callers can catch them broadly,
and every message names the object, the column and what is available.
"""

from __future__ import annotations


class StarmartError(ValueError):
    """Base class of all errors raised by starmart."""


class IntentError(StarmartError):
    """The question (metrics x dimensions x grain x filters) is malformed."""


class SpecError(StarmartError):
    """A mart specification references tables or columns that do not exist."""


class UnknownTableError(SpecError):
    """A table name is not among the loaded sources."""


class NonAdditiveMetricError(StarmartError):
    """A metric cannot be re-aggregated from an already aggregated fact."""


class CheckFailedError(StarmartError):
    """Publishing stopped because data checks reported violations."""

    def __init__(self, message: str, failures: list | None = None):
        super().__init__(message)
        self.failures = failures or []
