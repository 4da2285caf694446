"""Posting-and-pipeline analytics as composable Spark DataFrame operators."""
