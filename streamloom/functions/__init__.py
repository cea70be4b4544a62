"""Column functions for node chains: arithmetic, tests and text, all inside the JVM."""

from .scalar import add, divide, draw, floor_divide, floor_mod, is_odd, multiply, not_divisible, split_words, strip, subtract

__all__ = ["add", "divide", "draw", "floor_divide", "floor_mod", "is_odd", "multiply", "not_divisible", "split_words", "strip", "subtract"]
