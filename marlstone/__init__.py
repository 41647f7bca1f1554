"""Spark-first market-data and flow-analytics jobs."""
