"""Spark-native analysis of forum posts and of the people who wrote them."""
