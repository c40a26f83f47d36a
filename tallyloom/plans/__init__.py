"""All registered queries."""

from tallyloom.plans import landing, lineage, notes, runs, scores, streams, voting  # noqa: F401
from tallyloom.plans.catalog import ORACLES, QUERIES  # noqa: F401
