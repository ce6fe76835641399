"""Contribution and code-similarity analytics as Spark plans."""
