"""Document retrieval, graph analytics and corpus maintenance as Spark jobs."""
