"""docledger: a Spark-native engine for structured requirement documents."""
