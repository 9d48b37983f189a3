"""All queries of the engine, gathered by importing the modules that register them."""

from boostlake.plans import data_queries, metric_queries, model_queries, objective_queries
from boostlake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "data_queries", "metric_queries", "model_queries", "objective_queries"]
