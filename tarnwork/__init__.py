"""tarnwork: a PySpark engine for paired, incomplete measurement tables and training-data preparation."""
