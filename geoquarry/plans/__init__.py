"""Whole queries, built from operators, and what they share."""
