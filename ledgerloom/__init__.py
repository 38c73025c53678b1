"""Governed-data operators on Spark: masking, quality, lineage, compliance, catalogue."""
