"""kairosift: a Spark-native engine for versioned, time-aware document evidence."""
