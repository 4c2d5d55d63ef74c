"""Spark jobs for k-mer analytics: count, sort, merge, encode, store and print fixed-length DNA windows."""
