"""Operators on panels, series and events."""
