"""Slide-cohort analytics on Spark."""
