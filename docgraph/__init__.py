"""docgraph: documents, chunks and knowledge graphs as Spark DataFrames."""
