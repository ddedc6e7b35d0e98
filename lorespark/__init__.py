"""lorespark: Spark-native knowledge-base and corpus pipelines."""
