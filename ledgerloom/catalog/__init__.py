"""Registered queries, each with the SQL it is checked against."""

from ledgerloom.catalog import estate, governance, language, masking  # noqa: F401
from ledgerloom.catalog.base import CHECKS, QUERIES, Tables

__all__ = ["CHECKS", "QUERIES", "Tables"]
