"""Scalar functions of the catalogue, each from columns to a column."""
