"""DataFrame operators for graph data: patterns, paths, discovery, linking, retrieval and scoring."""
