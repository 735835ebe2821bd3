"""Revenue analytics on Spark DataFrames."""

from brindle.plans.revenue_by_nation import revenue_by_nation
from brindle.sources.tables import read_table

__all__ = ["read_table", "revenue_by_nation"]
