"""All queries of the library and their oracle SQL, by name."""

from __future__ import annotations

from trivane.plans import aggregations, association, audits, evaluation, files, measures, programs, records, relations, streams, texts
from trivane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregations", "association", "audits", "evaluation", "files", "measures", "programs", "records", "relations", "streams", "texts"]
