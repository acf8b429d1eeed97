"""A PySpark-native engine for sequencing-read tables and training-data corpora."""
