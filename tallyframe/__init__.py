"""tallyframe: attribute-level record reconciliation as composable Spark DataFrame operators."""
