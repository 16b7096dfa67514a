"""Fits, baselines, cross-validation and the registered queries."""
