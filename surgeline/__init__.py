"""Breadth, event studies and tilt backtests on Spark."""
