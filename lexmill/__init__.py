"""lexmill: corpus processing, retrieval and verification of documents as Spark jobs."""
