"""docledger: streaming."""
