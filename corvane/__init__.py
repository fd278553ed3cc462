"""A Spark-first engine for source-code and document corpora: files to symbols and chunks, ranked retrieval, graph and architecture analytics."""
