"""Input views, registered queries and composed plans."""

from __future__ import annotations


def all_queries() -> dict:
    """Import every query module once and return the registry."""
    from smogline.plans import (features, flagship, joins, models, profiles, scalars, series, sources,  # noqa: F401
                                streams, surfaces, tables)
    from smogline.plans.registry import QUERIES
    return QUERIES
