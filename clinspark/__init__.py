"""A PySpark-native analytics engine for noisy clinical-style text and records."""
