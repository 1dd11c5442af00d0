"""lakewarden: a PySpark-native engine for validating and transforming tabular submissions."""
