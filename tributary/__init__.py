"""Spark-native data processing with lineage: operators, sources, functions, plans and streaming."""
