"""Registered queries of the comparison engine, and their SQL."""

from __future__ import annotations

from docdelta.plans.oracles import ORACLES
from docdelta.plans.queries import QUERIES, job_verdicts

ENTRY = job_verdicts

__all__ = ["ENTRY", "ORACLES", "QUERIES"]
