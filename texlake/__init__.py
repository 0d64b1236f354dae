"""Spark jobs for corpora of LaTeX papers."""
