"""millrace: a Spark-native engine for curating large text and web corpora."""
