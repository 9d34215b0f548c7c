"""Part of loomgraph; see README.md."""
