"""Composite analyses built from the operators."""
