"""Spark-first analytics for software-engineering data: graphs, text, evidence, traces and streams."""
