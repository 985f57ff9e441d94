"""Seasonal and cross-sectional panel analytics, expressed as Spark DataFrame plans."""
