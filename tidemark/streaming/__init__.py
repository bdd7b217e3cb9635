"""Timers of the catalogue as streaming queries."""
