"""The library's queries by name, over the test tables, and the SQL of those that SQL can express."""

from weir.catalog import ORACLES, QUERIES
from weir.queries import connectors, ordered, relational, scalar, streams

__all__ = ["ORACLES", "QUERIES", "connectors", "ordered", "relational", "scalar", "streams"]
