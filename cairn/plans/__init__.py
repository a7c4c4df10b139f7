"""Named queries over the driver's tables, and the SQL that each must agree with."""

from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
