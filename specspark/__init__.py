"""Spark-native analytics for tandem mass spectra and their vectors."""
