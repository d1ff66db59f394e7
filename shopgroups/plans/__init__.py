"""Composite flows and the registered query catalogue."""
