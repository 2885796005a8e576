"""tessella: a Spark-native analytics engine over relational, nested and graph layouts."""

__version__ = "0.1.0"
