"""Find, redact and restore personal data in large text corpora on Spark."""
