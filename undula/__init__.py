"""undula: sample-entropy and variability analysis of many time-series signals on Spark."""

__version__ = "0.1.0"
