"""Spatial cell-population analytics and corpus preparation as Spark DataFrame operators."""
