"""loomgraph.sources."""
