"""A Spark-native engine for ranking, personalisation and training-data work."""
