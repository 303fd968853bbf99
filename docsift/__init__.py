"""PySpark-native evidence retrieval over long documents."""
