"""Tracking analytics and corpus operators on Spark DataFrames."""
