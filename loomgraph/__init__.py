"""loomgraph: source-code knowledge graphs as Spark DataFrames."""
