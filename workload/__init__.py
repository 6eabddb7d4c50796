"""Queries over the driver's tables, each with the ANSI SQL that has to give the same rows."""

from __future__ import annotations

import importlib

from workload.base import QUERIES, Query

for _module in (
    "grading", "rows", "combining", "counting", "wording", "cohorts", "outcomes", "scores", "drawing", "files",
):
    importlib.import_module(f"workload.{_module}")

__all__ = ["QUERIES", "Query"]
