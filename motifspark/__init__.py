"""motifspark: scoring of biological sequences, and corpus preparation, on PySpark."""
