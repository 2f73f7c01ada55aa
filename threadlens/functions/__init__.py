"""Column -> Column scalar functions (all native Spark expressions)."""
