"""Registered queries of the reference operators and their SQL."""

from casewright.queries import records, reports, scans, stores
from casewright.queries.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "records", "reports", "scans", "stores"]
