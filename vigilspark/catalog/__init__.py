"""All registered queries. Importing the family modules fills the registry."""

from vigilspark.catalog.base import ORACLE, QUERIES
from vigilspark.catalog import detection, metrics, records, streams  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
