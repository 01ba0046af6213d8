"""Checked queries over the supplied tables and their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = ("text_queries", "sampling_queries", "feature_queries", "model_queries", "stage_queries")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
