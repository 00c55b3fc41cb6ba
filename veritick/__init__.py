"""Spark jobs for auditable signal research: DataFrame in, DataFrame out."""
