"""Sensor-network analytics as PySpark table operators."""
