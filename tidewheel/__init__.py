"""Windowed order analytics on Spark: batch, streaming and recovery of keyed sums."""
