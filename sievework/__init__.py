"""Scoring, audit and monitoring operators on Spark DataFrames."""
