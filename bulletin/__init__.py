"""bulletin: Spark-native analytics over collections of official announcements."""
