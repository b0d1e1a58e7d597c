"""Corvana: corpus retrieval and analytics as PySpark DataFrame plans."""
