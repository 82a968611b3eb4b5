"""terrafold: a PySpark-native engine for official, place-based open data."""
