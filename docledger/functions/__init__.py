"""docledger: functions."""
