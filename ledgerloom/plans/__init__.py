"""Analytic templates, question routing and end-to-end jobs."""
