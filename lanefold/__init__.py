"""Multi-vector retrieval, retrieval evaluation and noisy-text tooling on Spark DataFrames."""

__version__ = "0.1.0"
