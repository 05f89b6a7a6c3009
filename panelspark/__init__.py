"""panelspark: Spark-native analytics over panels of irregular time series."""
