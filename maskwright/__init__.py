"""Find, report, mask and restore personal data in tables of documents with Spark."""
