"""foldergraph: document grouping and folder suggestions as Spark jobs."""
