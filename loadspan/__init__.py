"""Spark-native time-series segmentation and activity analytics."""
