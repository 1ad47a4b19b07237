"""loomgraph.operators."""
