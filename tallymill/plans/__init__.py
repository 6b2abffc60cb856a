"""Registered queries: each has a Spark callable and, where possible, plain SQL."""

from __future__ import annotations

from importlib import import_module

from tallymill.plans.registry import ORACLES, QUERIES

for _name in ("corpus", "packing", "completions", "prompts", "metrics", "outcomes", "patches"):
    import_module(f"tallymill.plans.{_name}")

__all__ = ["ORACLES", "QUERIES"]
