"""loomgraph.functions."""
