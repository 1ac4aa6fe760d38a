"""Semantic document matching and explainable ranking on Spark."""
