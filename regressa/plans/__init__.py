"""Composed plans: models, tuning, workflow."""
