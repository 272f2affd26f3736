"""A Spark-native engine for structured decision data and the corpora behind it."""
