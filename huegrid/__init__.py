"""Spark-native analytics for spectral images, label maps and repeated scores."""
