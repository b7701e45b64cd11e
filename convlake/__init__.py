"""A PySpark-native engine for conversation corpora: every operator is a DataFrame or Column transformation."""
