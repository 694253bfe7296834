"""lorekeep: a Spark-native store and retrieval engine for short text memories."""

__version__ = "0.1.0"
