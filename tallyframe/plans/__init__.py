"""Runnable reports: each pairs a Spark plan with an ANSI-SQL check."""

from __future__ import annotations

import importlib

from tallyframe.plans import registry

MODULES = (
    "cash", "ledger", "statements", "budget", "forecast", "tax", "currency", "signals", "text", "invoice", "validate", "records", "streams", "model",
)


def load_all():
    """All registered plans and checks, by report name."""
    for name in MODULES:
        importlib.import_module(f"tallyframe.plans.{name}")
    return dict(registry.PLANS), dict(registry.CHECKS)
