"""Curation, matching, splitting and scoring of scientific tables on Spark."""
