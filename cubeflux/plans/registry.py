"""Registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from . import kernels, selections, stored, transforms  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
