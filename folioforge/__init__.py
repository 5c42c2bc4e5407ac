"""folioforge: paged-text assembly, reconciliation and validation as composable Spark DataFrame operators."""
