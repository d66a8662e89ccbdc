"""corpusmill: document, retrieval and corpus analytics expressed as Spark jobs."""
