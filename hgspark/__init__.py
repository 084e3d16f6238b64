"""Knowledge hypergraphs on Spark: building, algebra, simplification and retrieval as DataFrame operators."""
