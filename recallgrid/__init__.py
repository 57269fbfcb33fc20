"""Memory-retrieval analytics on Spark: ranked recall, versioned rows, graphs, sessions and clustering as DataFrame operators."""
