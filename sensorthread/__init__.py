"""IoT readings joined to object-centric event logs, on Spark DataFrames."""

from sensorthread.session import apply_session_defaults

__all__ = ["apply_session_defaults"]
