"""Trajectory analytics for cursor-tracking experiments, as plain Spark DataFrame work."""
