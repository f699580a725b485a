"""Bank-ledger jobs on Spark."""
