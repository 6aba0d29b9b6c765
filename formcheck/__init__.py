"""formcheck: Spark jobs for quality control of documents and forms."""
