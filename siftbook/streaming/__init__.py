"""Restartable incremental jobs."""
