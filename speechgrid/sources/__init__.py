"""Readers, stores and the views derived from the supplied tables."""
