"""Operators for large training-text pipelines. Nothing outside this folder imports it."""
