"""quillon: a PySpark-native engine for event timelines and token sequences."""
