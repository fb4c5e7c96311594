"""Tidemark: equity-panel analytics as Spark DataFrame operators."""
