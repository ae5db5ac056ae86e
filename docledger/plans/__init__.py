"""docledger: plans."""
