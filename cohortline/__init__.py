"""Cohort and longitudinal-variant analytics expressed as plain PySpark DataFrame operators."""
