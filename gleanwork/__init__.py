"""gleanwork: a PySpark-native engine for evidence retrieval, its evaluation and corpus analytics."""
