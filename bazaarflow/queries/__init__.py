"""All registered queries."""

import importlib

_MODULES = ("sources", "reports", "series", "features", "evaluation", "published", "comparison", "streams", "training")


def load():
    """Import every query module once and return (queries, oracles)."""
    from bazaarflow.queries import base

    for name in _MODULES:
        importlib.import_module(f"bazaarflow.queries.{name}")
    return dict(base.QUERIES), dict(base.ORACLES)
