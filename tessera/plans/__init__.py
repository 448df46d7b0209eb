"""Registered queries over the driver's tables."""

from tessera.plans import registry
from tessera.plans import extended  # noqa: F401  registers more

__all__ = ["registry"]
