"""Metric monitoring on Spark: readings, headlines, triggers, gates and briefs."""
