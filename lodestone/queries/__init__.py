"""Registered queries over the driver's tables, and their SQL."""

from lodestone.queries.catalogue import FLAGSHIP, ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
