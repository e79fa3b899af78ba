"""siltstone: a PySpark-native time-series lakehouse and data-processing engine."""
