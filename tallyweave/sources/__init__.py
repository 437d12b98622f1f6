"""Where nodes and edges come from and go to: markdown trees, graph exports, snapshots, embedding providers."""
