"""Whole analyses and the batch job."""
