"""Scalar functions and aggregates of queries, as Spark columns."""
