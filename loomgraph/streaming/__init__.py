"""loomgraph.streaming."""
