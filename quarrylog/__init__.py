"""Log analytics and rule-based anomaly detection on Spark DataFrames."""

__version__ = "0.1.0"
