"""Detection-data analytics on Spark: annotations, detections, tracks and embeddings as DataFrames."""

__version__ = "0.1.0"
