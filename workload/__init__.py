"""Registered queries over the driver's tables, with their SQL counterparts."""

from . import tables, vectors  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
