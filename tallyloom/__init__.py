"""Rubric analytics on Spark: profiling, validation, score rollups and text relations as DataFrame jobs."""
