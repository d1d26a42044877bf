"""Queries over the driver's tables."""

from . import composed, registry  # noqa: F401
