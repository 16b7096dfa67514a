"""Operators on DataFrames of observations, moments, weight matrices and pairs."""
