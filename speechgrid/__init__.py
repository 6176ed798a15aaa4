"""Timed-speech analytics on Spark: table-in / table-out operators keyed by recording."""
