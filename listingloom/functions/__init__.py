"""Scalar functions as Column expressions, and the few Python functions Spark lacks."""
