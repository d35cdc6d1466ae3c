"""Registered queries; importing the package fills the registry."""

from memspark.catalog import basics, ingest, lifecycle, retrieval, scoring  # noqa: F401
from memspark.catalog.registry import QUERIES, SQL  # noqa: F401
