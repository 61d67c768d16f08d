"""Kinfold: cleaning, record linkage, survivorship, lineage, review and rollups as Spark DataFrame operators."""
