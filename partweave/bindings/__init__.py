"""Queries over the driver's tables, one per operator, with equivalent SQL for the oracle."""


def registry():
    from . import analytics, governance, incremental, matching, text  # noqa: F401  (registration on import)
    from .base import ORACLES, QUERIES

    incremental.finish()
    return dict(QUERIES), dict(ORACLES)
