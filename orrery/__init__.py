"""Trajectory and topology analytics as Spark DataFrame plans."""
