"""A PySpark-native engine for deterministic record processing."""
