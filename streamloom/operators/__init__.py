"""Operator nodes."""

from .aggregates import Aggregate, Average, Count, KeyedSum, Max, Min, PythonAggregate, Running, RunningCount, StdDev, Sum, TwoPhase
from .maps import (
    Apply, ApplyField, Bernoulli, ConcatPorts, Delay, FlatMap, Identity, Join, PickPort, PythonApply, PythonNode, RenamePorts, Select, SetOperation, Sieve, Split, SqlNode, Tagged, Tokenise, TopK, Where, chain,
)
from .signal import Bandpass, Decimate, Demean, DetrendLinear, DetrendSimple, GainNorm, MeanNorm, Numbered, OneBit, PerTrace, Whiten, WhitenSmooth, whiten

__all__ = [
    "Aggregate", "Apply", "ApplyField", "Average", "Bandpass", "Bernoulli", "ConcatPorts", "Count", "Decimate", "Delay", "Demean", "DetrendLinear", "DetrendSimple", "FlatMap", "GainNorm", "Identity", "Join",
    "KeyedSum", "Max", "MeanNorm", "Min", "Numbered", "OneBit", "PerTrace", "PickPort", "PythonAggregate", "PythonApply", "PythonNode", "RenamePorts", "Running", "RunningCount", "Select",
    "SetOperation", "Sieve", "Split", "SqlNode", "StdDev", "Sum", "Tagged", "Tokenise", "TopK", "TwoPhase", "Where", "Whiten", "WhitenSmooth", "chain", "whiten",
]
