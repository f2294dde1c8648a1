"""kinloom: identity resolution, curation and evaluation as PySpark DataFrame operators."""
