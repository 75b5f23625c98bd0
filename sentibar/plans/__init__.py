"""Composed plans and the registered query catalogue."""

from .catalog import REGISTRY, Query  # noqa: F401


def load_all() -> dict:
    """Import every query module so that REGISTRY is complete."""
    from . import q_align, q_io, q_ml, q_models, q_prices, q_quality, q_stream, q_text  # noqa: F401
    return REGISTRY
