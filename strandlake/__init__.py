"""Differential k-mer analytics on Spark: two read sets, normal and tumor, compared without a reference."""
