"""quarry: a Spark-native engine for retrieval, link-graph and corpus analytics."""

__version__ = "0.1.0"
