"""Artifact usage analytics as Spark DataFrame functions."""
