"""halyard: a Spark-native vector analytics engine."""

__version__ = "0.1.0"
