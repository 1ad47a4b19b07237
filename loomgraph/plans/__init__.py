"""loomgraph.plans."""
