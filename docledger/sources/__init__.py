"""docledger: sources."""
