"""Whole queries: the Spark plan and the SQL it must agree with."""
