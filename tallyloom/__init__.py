"""Dataset-integrity, sampling, deduplication and detection-metric operators on Spark DataFrames."""
