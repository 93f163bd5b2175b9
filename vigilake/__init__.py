"""Spark-native analytics over package releases, file contents and sandbox traces."""
