"""Pluvia: Spark jobs for multi-station field sensing and corpus preparation."""
