"""marketloom: a PySpark-native market-price analytics engine."""

__version__ = "0.1.0"
