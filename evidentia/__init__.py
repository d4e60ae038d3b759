"""A PySpark-native engine for bitemporal, cited facts."""
