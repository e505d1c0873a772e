"""evenkeel: table comparison, reconciliation and change-data analytics on Spark."""
