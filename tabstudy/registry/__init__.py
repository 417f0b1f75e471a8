"""Registered queries, one per operator."""

from importlib import import_module

from .base import ORACLES, QUERIES

for _module in ("tables", "audit", "shaping", "evaluate", "testing", "modelling", "closed_forms"):
    import_module(f"{__name__}.{_module}")

__all__ = ["ORACLES", "QUERIES"]
