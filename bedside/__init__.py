"""Clinical event-table analytics as composable PySpark DataFrame operators."""
