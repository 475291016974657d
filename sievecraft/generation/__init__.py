"""Asking a model for samples: tasks, strategies, providers and the engine that runs them on Spark."""
