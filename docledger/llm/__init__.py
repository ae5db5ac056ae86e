"""Training-data operators. Nothing else in docledger imports this subpackage."""
