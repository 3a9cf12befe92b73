"""A Spark-native analytics engine: compact expression queries and SQL over files of many formats."""
