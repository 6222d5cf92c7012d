"""Evidence-based reconciliation of noisy, semi-structured records on Spark DataFrames."""
