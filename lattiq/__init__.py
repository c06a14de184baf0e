"""Dense-subgraph analytics on Spark: clean edges, count cliques, peel nuclei."""
