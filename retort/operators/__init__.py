"""Operators on signals, features, splits and predictions."""
