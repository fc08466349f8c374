"""Corpus and evaluation analytics as Spark DataFrame functions."""
