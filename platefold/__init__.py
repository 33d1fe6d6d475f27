"""Meal-macro analytics as Spark DataFrame plans."""
