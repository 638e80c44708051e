"""ridgeline: a PySpark-native engine for trajectory telemetry and training-data preparation."""
