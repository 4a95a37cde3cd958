"""Hashes of option texts: two public 64-bit string hashes that multiply and add, byte by byte."""

from __future__ import annotations

from functools import reduce

_ALL = (1 << 64) - 1
#: Start and factor of each, fixed values.
METHODS = {"djb2": (5381, 33), "sdbm": (0, 65599)}


def text_hash(text: str, method: str = "djb2") -> int:
    start, factor = METHODS[method]
    return reduce(lambda h, c: (h * factor + c) & _ALL, text.encode(), start)
