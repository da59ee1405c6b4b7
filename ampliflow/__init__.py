"""Spark-native amplicon analytics: reads to tallies, thresholds, species, reports and accuracy."""
