"""Presage: point-in-time predictive analytics as Spark DataFrame plans."""
