"""Analytics over monthly account-level credit panels, as Spark DataFrame operators."""
