"""strandwork: analytics over linked artefacts as plain PySpark operators."""
