"""Tabular analytics on Spark: profile, clean, engineer, prepare, train, evaluate and explain tables."""
