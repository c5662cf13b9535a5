"""Spec-driven lakehouse engine on Spark: sources, quality, history, upserts, marts and insight queries."""
