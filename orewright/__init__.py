"""A Spark-native engine for layered (bronze / silver) tables and large-scale data preparation."""
