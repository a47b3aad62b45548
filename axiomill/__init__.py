"""axiomill: a PySpark-native engine for corpora of mathematical statements."""
