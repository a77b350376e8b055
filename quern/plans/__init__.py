"""Planning on the driver: predicates, pushdown, cost, splits. No Spark job starts here."""
