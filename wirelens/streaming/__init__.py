"""Structured Streaming versions of the flow and Layer-2 jobs."""
