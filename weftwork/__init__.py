"""weftwork: a PySpark-native analytics engine for text corpora and business tables."""
