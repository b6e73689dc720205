"""tidemill: a Spark-native engine for curating document corpora."""
