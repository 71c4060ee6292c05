"""spanlake: agent-telemetry event logs folded into current-state tables on Spark."""

from spanlake.session import build_session, configure

__all__ = ["build_session", "configure"]
