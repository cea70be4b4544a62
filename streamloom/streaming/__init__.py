"""The same graphs on streams, and nodes that keep state between micro-batches."""

from .runner import BoundedStream, StreamRun, run_stream, to_completion
from .state import DailyWindow, StreamCount, StreamRunningCount, StreamRunningSum

__all__ = ["BoundedStream", "DailyWindow", "StreamCount", "StreamRun", "StreamRunningCount", "StreamRunningSum", "run_stream", "to_completion"]
