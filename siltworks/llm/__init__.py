"""Operators for training-data problems. Nothing outside this folder imports it."""
