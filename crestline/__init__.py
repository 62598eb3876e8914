"""Terrain-horizon analytics as Spark DataFrame operators."""
