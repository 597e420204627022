from timeloom.plans import assembly_queries, case_queries, frame_queries, gate_queries, interval_queries, more_queries, number_queries, quality_queries, rule_queries, store_queries, subset_queries  # noqa: F401  they register their queries
from timeloom.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
