"""Cohort analytics over annotated clinical text, written as Spark DataFrame plans."""
