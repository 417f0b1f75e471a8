"""Shared column functions and distributed primitives."""
