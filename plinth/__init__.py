"""plinth: a Spark-native engine for tabular analytics and machine learning."""
