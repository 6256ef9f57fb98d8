"""Operators for training-data pipelines on Spark tables of documents and pages."""
