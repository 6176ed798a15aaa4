"""Operators for building training data: texts, vectors and conversations."""
