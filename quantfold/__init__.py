"""quantfold: Spark-native time-series, panel and text-signal analytics."""

__version__ = "0.1.0"
