"""Query-history analytics on Spark: ingest, statement shapes, pricing and the usual cost and latency reads."""

from runledger.plans.dashboard import Dashboard
from runledger.plans.params import EventFilter, ListOptions, TimeRange

__all__ = ["Dashboard", "EventFilter", "ListOptions", "TimeRange"]
