"""Regulatory compliance analytics as Spark DataFrame and Structured Streaming operators."""
