"""Query plans: the metrics layer, the domain model and the registered queries."""

from __future__ import annotations

import importlib

# modules whose import registers queries, in survey order
PLAN_MODULES = [
    "voltaic.plans.business",
    "voltaic.plans.relational",
    "voltaic.plans.text",
    "voltaic.plans.search",
    "voltaic.plans.conversation",
    "voltaic.plans.generated",
    "voltaic.plans.domain",
    "voltaic.plans.storage",
]


def load_all():
    from voltaic.plans.registry import ORACLES, QUERIES
    for m in PLAN_MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLES
