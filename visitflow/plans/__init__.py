"""Fit and apply pipelines composed from the operators."""
