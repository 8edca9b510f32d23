"""labelaudit: audit and correct labelled text corpora on Spark DataFrames."""

__version__ = "0.1.0"
