"""docledger: operators."""
