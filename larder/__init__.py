"""larder: a Spark-native engine for document collections and the quantities they state."""

__version__ = "0.1.0"
