"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from . import queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
