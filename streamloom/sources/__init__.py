"""Source and sink nodes, and the inputs of a run."""

from .inputs import load_inputs
from .sinks import Discard, LogLines, PerKeyFiles, Show, Write
from .sources import WORDS, Burst, Counter, Files, IntRange, Iterations, Multiples, RandomWords, Rate, Rows, StreamFrom, Table, TextLines, Traces, python_source

__all__ = ["WORDS", "Burst", "Counter", "Discard", "Files", "IntRange", "Iterations", "LogLines", "Multiples", "PerKeyFiles", "RandomWords", "Rate", "Rows", "Show", "StreamFrom", "Table", "TextLines", "Traces", "Write", "load_inputs", "python_source"]
