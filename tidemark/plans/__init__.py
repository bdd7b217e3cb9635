"""Helpers that shape plans: shared folders, lineage cuts, distributed prefix sums."""
