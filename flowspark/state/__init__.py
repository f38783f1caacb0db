"""Keyed state with exactly-once updates, and queries against it."""

from flowspark.state.table import NON_TRANSACTIONAL, OPAQUE, TRANSACTIONAL, StateTable

__all__ = ["NON_TRANSACTIONAL", "OPAQUE", "TRANSACTIONAL", "StateTable"]
