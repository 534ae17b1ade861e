"""weftline: a Spark-first engine for documents, vectors, graphs and conversations."""
