"""Composed jobs: scoring, reports and the query catalogue."""
