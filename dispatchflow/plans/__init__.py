"""The two queries, from envelope to result."""

from dispatchflow.plans.counts import counts_plan, enriched_plan

__all__ = ["counts_plan", "enriched_plan"]
